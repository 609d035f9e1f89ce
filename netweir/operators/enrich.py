"""Flow enrichment: device, interface, geography, autonomous system, site.

A missing lookup leaves the empty string or 0, never NULL, and never drops a flow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.operators.joins import BROADCAST_BYTES, PrefixTable, fits_broadcast, longest_prefix, lookup_left, measured_bytes, with_words


SIDES = ("src", "dst")
#: Interfaces whose index agrees but for so many bits are looked up as one row.
BLOCK_BITS = 6


@dataclass(frozen=True)
class Dimensions:
    """Lookup tables of the enrichment; an absent table leaves its columns alone.

    device: mgmt_ip, name, site, region, role.  interface: mgmt_ip, snmp_index, name, speed.
    geo: prefix, plen, country, city.  asn: prefix, plen, asn, as_name.
    """

    device: DataFrame | None = None
    interface: DataFrame | None = None
    geo: PrefixTable | None = None
    asn: PrefixTable | None = None
    sizes: dict[str, bool] = field(default_factory=dict, compare=False)

    def small(self, name: str) -> bool:
        """Whether a table may be broadcast; measured once, when it is first asked for."""
        if name not in self.sizes:
            self.sizes[name] = fits_broadcast(getattr(self, name))
        return self.sizes[name]


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def enrich_device(flows: DataFrame, device: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Exporter name, site, region and role by the exporter's management address."""
    fields = {"exporter_name": "name", "exporter_site": "site", "exporter_region": "region", "exporter_role": "role"}
    dim = device.select(
        F.col("mgmt_ip").alias("exporter_ip"),
        F.struct(*[_or(F.col(c), "").alias(c) for c in fields.values()]).alias("_device"),
    )
    joined = lookup_left(flows, dim, ["exporter_ip"], broadcast=broadcast)
    return joined.withColumns(
        {target: F.coalesce(F.col(f"_device.{source}"), F.col(target)) for target, source in fields.items()}
    ).drop("_device")


def enrich_interfaces(
    flows: DataFrame, device: DataFrame, interface: DataFrame, broadcast: bool | None = None
) -> DataFrame:
    """Name and speed of both interfaces; looked up only where the device is known."""
    known = interface.join(device.select("mgmt_ip"), "mgmt_ip", "left_semi")
    if broadcast is None:
        broadcast = fits_broadcast(known)
    if not broadcast:
        packed = _in_blocks(known)
        if packed is not None:
            return _from_blocks(flows, *packed)
    result = flows
    for side in ("in_if", "out_if"):
        dim = known.select(
            F.col("mgmt_ip").alias("exporter_ip"),
            F.col("snmp_index").cast("long").alias(side),
            F.struct(_or(F.col("name"), "").alias("name"), _or(F.col("speed"), 0).cast("long").alias("speed")).alias("_if"),
        )
        result = lookup_left(result, dim, ["exporter_ip", side], broadcast=broadcast)
        result = result.withColumns(
            {f"{side}_{c}": F.coalesce(F.col(f"_if.{c}"), F.col(f"{side}_{c}")) for c in ("name", "speed")}
        ).drop("_if")
    return result


def _in_blocks(known: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame] | None:
    """Interfaces as one row per exporter and block of indexes (index and code of each), and the
    values by code. None if an index comes twice, or if either is too large to be sent.

    Interfaces are many, but names and speeds are few, so the codes take a fraction of the text.
    """
    rows = known.select(
        F.col("mgmt_ip").alias("exporter_ip"), F.col("snmp_index").cast("long").alias("index"),
        F.struct(_or(F.col("name"), "").alias("name"), _or(F.col("speed"), 0).cast("long").alias("speed")).alias("_if"),
    ).where(F.col("exporter_ip").isNotNull() & F.col("index").isNotNull())
    distinct = rows.select("_if").distinct()
    if not fits_broadcast(distinct, max_bytes):
        return None
    values = distinct.withColumn("code", F.row_number().over(Window.orderBy("_if")))
    entries = F.collect_list(F.struct("index", "code")).alias("_entries")
    blocks = rows.join(F.broadcast(values), "_if").groupBy("exporter_ip", F.shiftright("index", BLOCK_BITS).alias("_block")).agg(entries)
    twice = F.size(F.array_distinct("_entries.index")) < F.size("_entries")
    size = blocks.agg(F.sum(64 + 16 * F.size("_entries")).alias("bytes"), F.max(twice).alias("twice")).first()
    return None if size["twice"] or (size["bytes"] or 0) > max_bytes else (blocks, values)


def _entry_of(side: str) -> Column:
    # A higher-order function is not compiled into the stage: what is before and after it are
    # compiled methods of their own, which stay below HotSpot's limit.
    return F.get(F.filter("_entries", lambda entry: entry["index"] == F.col(side)), F.lit(0))


def _from_blocks(flows: DataFrame, blocks: DataFrame, values: DataFrame) -> DataFrame:
    """Both interfaces of a flow by their codes; the flows do not move."""
    result = flows
    for side in ("in_if", "out_if"):
        result = result.withColumn("_block", F.shiftright(F.col(side).cast("long"), BLOCK_BITS))
        result = lookup_left(result, blocks, ["exporter_ip", "_block"], broadcast=True)
        result = result.withColumn("code", _entry_of(side)["code"]).drop("_entries", "_block")
        result = lookup_left(result, values, ["code"], broadcast=True).withColumns(
            {f"{side}_{c}": F.coalesce(F.col(f"_if.{c}"), F.col(f"{side}_{c}")) for c in ("name", "speed")}
        ).drop("_if", "code")
    return result


def enrich_geo(flows: DataFrame, geo: PrefixTable, strategy: str = "auto", sides: tuple[str, ...] = SIDES) -> DataFrame:
    """Country and city of the ends; overwritten by '' where nothing covers the address."""
    result = flows
    for side in sides:
        result = longest_prefix(
            result, f"{side}_ip", geo, {"country": "_country", "city": "_city"}, strategy
        )
        empty = F.octet_length(f"{side}_ip") == 0
        result = result.withColumns(
            {
                f"{side}_{name}": F.when(empty, F.col(f"{side}_{name}")).otherwise(_or(F.col(f"_{name}"), ""))
                for name in ("country", "city")
            }
        ).drop("_country", "_city")
    return result.drop(*_helpers(flows, result))


def enrich_asn(flows: DataFrame, asn: PrefixTable, strategy: str = "auto", sides: tuple[str, ...] = SIDES) -> DataFrame:
    """AS name of the ends; the AS number is filled only where the flow carries 0."""
    result = flows
    for side in sides:
        result = longest_prefix(
            result, f"{side}_ip", asn, {"asn": "_asn", "as_name": "_as_name"}, strategy
        )
        empty = F.octet_length(f"{side}_ip") == 0
        number, name = f"{side}_as", f"{side}_as_name"
        result = result.withColumns(
            {
                number: F.when(F.col(number) == 0, _or(F.col("_asn"), 0)).otherwise(F.col(number)),
                name: F.when(empty, F.col(name)).otherwise(_or(F.col("_as_name"), "")),
            }
        ).drop("_asn", "_as_name")
    return result.drop(*_helpers(flows, result))


def _helpers(before: DataFrame, after: DataFrame) -> list[str]:
    """Address numbers this step added for itself; those of the caller stay."""
    return [c for c in after.columns if c.startswith(("_hi_", "_lo_", "_v4_")) and c not in before.columns]


def enrich_sites(flows: DataFrame, site_prefix: PrefixTable, strategy: str = "auto") -> DataFrame:
    """Source and destination site by address; '' where no site owns it."""
    result = flows
    for side in ("src", "dst"):
        result = longest_prefix(result, f"{side}_ip", site_prefix, {"site": f"{side}_site"}, strategy)
        result = result.withColumn(f"{side}_site", _or(F.col(f"{side}_site"), ""))
    return result.drop(*_helpers(flows, result))


def enrich(flows: DataFrame, dims: Dimensions, strategy: str = "auto") -> DataFrame:
    """All lookups in order: device, interfaces, geography, autonomous system."""
    columns = flows.columns
    result = flows
    if dims.device is not None:
        result = enrich_device(result, dims.device, dims.small("device"))
        if dims.interface is not None:
            result = enrich_interfaces(result, dims.device, dims.interface, dims.small("interface"))
    if dims.geo is not None and dims.asn is not None:
        result = with_words(with_words(result, "src_ip"), "dst_ip")
    if dims.geo is not None:
        result = enrich_geo(result, dims.geo, strategy)
    if dims.asn is not None:
        result = enrich_asn(result, dims.asn, strategy)
    return result.select(*columns)
