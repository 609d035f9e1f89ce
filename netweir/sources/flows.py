"""Flow records: wire shape to the canonical table row, and stream adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.functions.ip import wire_to_binary
from netweir.schema import DIRECTIONS, FLOW_COLUMNS, FLOW_TYPES, WIRE_FLOW


def _label(code: Column, labels: dict[int, str]) -> Column:
    result = F.lit("unknown")
    for number, text in labels.items():
        result = F.when(code == number, text).otherwise(result)
    return result


def to_canonical(wire: DataFrame) -> DataFrame:
    """Wire record to table row: milliseconds to ``ts``, codes to labels, 16-byte addresses.

    Fields a sender left out get the wire format's defaults, so nothing is NULL.
    """
    present = set(wire.columns)
    columns = []
    for field in WIRE_FLOW:
        name = field.name
        kind = field.dataType.typeName()
        default = {"string": F.lit(""), "binary": F.expr("X''")}.get(kind, F.lit(0).cast(field.dataType))
        value = F.coalesce(F.col(name).cast(field.dataType), default) if name in present else default
        if name == "timestamp_ms":
            value = F.timestamp_millis(value)
            name = "ts"
        elif name == "flow_type":
            value = _label(value, FLOW_TYPES)
        elif name == "direction":
            value = _label(value, DIRECTIONS)
        elif name in ("src_ip", "dst_ip"):
            value = wire_to_binary(value)
        columns.append(value.alias(name))
    return wire.select(*columns).select(*FLOW_COLUMNS)


def read_flow_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of wire records from landed Parquet files."""
    reader = spark.readStream.schema(WIRE_FLOW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def read_flow_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    descriptor_path: str,
    message: str = "EnrichedFlow",
    max_offsets_per_trigger: int = 5_000_000,
) -> DataFrame:
    """Stream of wire records from a topic; a message that does not decode is skipped.

    Needs the Kafka and protobuf connectors on the class path.
    """
    from pyspark.sql.protobuf.functions import from_protobuf

    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        .load()
    )
    decoded = raw.select(
        "topic", "partition", "offset",
        from_protobuf(
            "value", message, descriptor_path, {"mode": "PERMISSIVE", "enums.as.ints": "true"}
        ).alias("flow"),
    )
    return skip_undecoded(decoded)


def skip_undecoded(decoded: DataFrame) -> DataFrame:
    """Drop the messages whose decoder gave NULL and unpack the others."""
    extra = [c for c in decoded.columns if c != "flow"]
    return decoded.where(F.col("flow").isNotNull()).select(*extra, "flow.*")


def write_flow_topic(
    flows: DataFrame, servers: str, topic: str, descriptor_path: str, checkpoint: str, message: str = "EnrichedFlow"
):
    """Enriched wire records to a topic, acknowledged by all replicas, lz4-compressed."""
    from pyspark.sql.protobuf.functions import to_protobuf

    payload = flows.select(to_protobuf(F.struct(*flows.columns), message, descriptor_path).alias("value"))
    return (
        payload.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("kafka.acks", "all")
        .option("kafka.compression.type", "lz4")
        .option("checkpointLocation", checkpoint)
        .start()
    )
