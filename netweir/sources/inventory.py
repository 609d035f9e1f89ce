"""Inventory pages landed as JSON text: devices and interfaces for the flow lookups.

A page that is not valid JSON fails the load, so a broken export never empties the
lookup tables. A single element that does not parse is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.functions.ip import strip_cidr, text_to_u32

PAGE = "count INT, next STRING, previous STRING, results ARRAY<STRING>"
DEVICE = """id BIGINT, name STRING, primary_ip STRUCT<address: STRING>, site STRUCT<name: STRING>,
    region STRUCT<name: STRING>, role STRUCT<name: STRING>, _bad STRING"""
INTERFACE = "id BIGINT, name STRING, speed BIGINT, custom_fields STRUCT<snmp_index: BIGINT>, label STRING, _bad STRING"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed page file: its path as ``page`` and its text as ``value``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page"), "value")


def elements(pages: DataFrame, schema: str) -> DataFrame:
    """Parsed elements of all pages with their load order (page, position)."""
    body = F.from_json("value", PAGE, {"mode": "FAILFAST"})
    keep = [c for c in pages.columns if c != "value"]
    raw = pages.select(*keep, F.posexplode(body["results"]).alias("position", "element"))
    parsed = raw.withColumn(
        "e", F.from_json("element", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    )
    return parsed.where(F.col("e").isNotNull() & F.col("e._bad").isNull()).select(*keep, "position", "e.*")


def devices(pages: DataFrame) -> DataFrame:
    """Device lookup by management address: the last loaded device of an address wins."""
    parsed = elements(pages, DEVICE)
    rows = parsed.where(F.coalesce("primary_ip.address", F.lit("")) != "").select(
        strip_cidr(F.col("primary_ip.address")).alias("mgmt_text"),
        F.struct("page", "position").alias("loaded"),
        F.struct(
            F.col("id").alias("device_id"),
            F.coalesce("name", F.lit("")).alias("name"),
            F.coalesce("site.name", F.lit("")).alias("site"),
            F.coalesce("region.name", F.lit("")).alias("region"),
            F.coalesce("role.name", F.lit("")).alias("role"),
        ).alias("device"),
    )
    last = rows.groupBy("mgmt_text").agg(F.max_by("device", "loaded").alias("device"))
    return last.select("mgmt_text", text_to_u32(F.col("mgmt_text")).alias("mgmt_ip"), "device.*")


def snmp_index(custom: Column, label: Column) -> Column:
    """The custom field if set, else the leading number of the label; NULL if not positive."""
    number = F.regexp_extract(label, r"^\s*([+-]?\d+)", 1)
    index = F.coalesce(custom, F.nullif(number, F.lit("")).try_cast("bigint"))
    return F.when(index > 0, index)


def interfaces(pages: DataFrame) -> DataFrame:
    """Interface lookup per device and SNMP index; pages carry ``device_id``."""
    parsed = elements(pages, INTERFACE).withColumn(
        "snmp_index", snmp_index(F.col("custom_fields.snmp_index"), F.col("label"))
    )
    usable = parsed.where(F.col("snmp_index").isNotNull()).select(
        "device_id",
        "snmp_index",
        F.struct("page", "position").alias("loaded"),
        F.struct(
            F.coalesce("name", F.lit("")).alias("name"), F.coalesce("speed", F.lit(0)).cast("bigint").alias("speed")
        ).alias("interface"),
    )
    last = usable.groupBy("device_id", "snmp_index").agg(F.max_by("interface", "loaded").alias("interface"))
    return last.select("device_id", "snmp_index", "interface.*")


def by_address(device: DataFrame, interface: DataFrame) -> DataFrame:
    """Interfaces keyed by the management address of their device, as the flow lookup wants them."""
    return interface.join(device.select("device_id", "mgmt_ip"), "device_id").select(
        "mgmt_ip", "snmp_index", "name", "speed"
    )


def paged(rows: DataFrame, keys: list[str], order: str, element: Column, size: int = 100) -> DataFrame:
    """Write rows as JSON pages of at most ``size`` elements; ``order`` numbers rows from 0.

    ``keys`` go along as columns. Used to land an inventory for later loads.
    """
    page = F.floor(F.col(order) / size).cast("long").alias("page_no")
    listed = rows.select(*keys, page, F.struct(F.col(order).alias("n"), element.alias("text")).alias("item"))
    texts = F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"])
    grouped = listed.groupBy(*keys, "page_no").agg(texts.alias("texts"))
    return grouped.select(
        *keys,
        F.lpad(F.col("page_no").cast("string"), 12, "0").alias("page"),
        F.concat(
            F.lit('{"count":'), F.size("texts").cast("string"), F.lit(',"next":null,"previous":null,"results":['),
            F.concat_ws(",", "texts"), F.lit("]}"),
        ).alias("value"),
    )


__all__ = ["read_pages", "elements", "devices", "interfaces", "snmp_index", "by_address", "paged"]
