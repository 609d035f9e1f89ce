"""Collector targets from a device inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: defaults of the generated targets ---------------------------
GNMI_PORT = 6030
DEFAULT_SUBSCRIPTIONS = ["default-counters", "default-system"]
FALLBACK_SUBSCRIPTION = "default-bgp"
DEFAULT_PROBES = ["icmp"]
PROBE_TARGETS = {"tcp_connect": ("", ":22"), "http_2xx": ("https://", "")}
# (vendor, platform) to module; platform '' stands for any other platform of the vendor.
SNMP_MODULES = {
    ("arista", ""): "arista_eos",
    ("cisco", "iosxe"): "cisco_iosxe",
    ("cisco", "nxos"): "cisco_nxos",
    ("cisco", ""): "cisco_ios",
    ("juniper", ""): "juniper_junos",
    ("paloalto", ""): "paloalto_panos",
}
FALLBACK_MODULE = "if_mib"
# label: inventory column
DEVICE_LABELS = {
    "device": "name", "site": "site", "region": "region", "vendor": "manufacturer",
    "platform": "platform", "role": "role", "tier": "monitoring_tier",
}
PROBE_LABELS = ["device", "site", "region"]


def snmp_module(vendor: Column, platform: Column) -> Column:
    """Default collector module of a device."""
    result = F.lit(FALLBACK_MODULE)
    # The any-platform entries are tried last, so they are wrapped innermost.
    for (name, kind), module in sorted(SNMP_MODULES.items(), key=lambda entry: entry[0][1] != ""):
        hit = (vendor == name) & ((platform == kind) if kind else F.lit(True))
        result = F.when(hit, module).otherwise(result)
    return result


def label_map(names: list[str], extra: dict[str, Column] | None = None) -> Column:
    pairs = {n: F.coalesce(F.col(DEVICE_LABELS[n]), F.lit("")) for n in names}
    pairs.update(extra or {})
    return F.create_map(*[x for name in sorted(pairs) for x in (F.lit(name), pairs[name])])


def _addressed(devices: DataFrame) -> DataFrame:
    return devices.where(F.coalesce("primary_ip_address", F.lit("")) != "")


def gnmi_targets(devices: DataFrame) -> DataFrame:
    """Streaming-telemetry targets by ``name:port``; the later device of a key wins."""
    port = F.coalesce("custom_fields.gnmi_port", F.lit(0))
    port = F.when(port == 0, GNMI_PORT).otherwise(port).cast("string")
    profile = F.coalesce("telemetry_profile", F.lit(""))
    subscriptions = F.array(
        *[F.lit(s) for s in DEFAULT_SUBSCRIPTIONS], F.when(profile != "", profile).otherwise(FALLBACK_SUBSCRIPTION)
    )
    rows = _addressed(devices).where("custom_fields.gnmi_enabled").select(
        F.concat("name", F.lit(":"), port).alias("target_key"),
        F.col("id"),
        F.struct(
            F.concat("primary_ip_address", F.lit(":"), port).alias("address"),
            label_map(list(DEVICE_LABELS)).alias("labels"),
            subscriptions.alias("subscriptions"),
        ).alias("target"),
    )
    return rows.groupBy("target_key").agg(F.max_by("target", "id").alias("target")).select("target_key", "target.*")


def snmp_targets(devices: DataFrame) -> DataFrame:
    """Polling target groups: one address, seven labels and the module."""
    own = F.coalesce("custom_fields.snmp_module", F.lit(""))
    module = F.when(own != "", own).otherwise(snmp_module(F.col("manufacturer"), F.col("platform")))
    return _addressed(devices).where("custom_fields.snmp_enabled").select(
        F.array("primary_ip_address").alias("targets"),
        label_map(list(DEVICE_LABELS), {"__param_module": module}).alias("labels"),
    )


def _probes() -> Column:
    listed = F.coalesce("custom_fields.blackbox_probes", F.array().cast("array<string>"))
    return F.when(F.size(listed) == 0, F.array(*[F.lit(p) for p in DEFAULT_PROBES])).otherwise(listed)


def probe_target(address: Column, probe: Column) -> Column:
    result = address
    for name, (before, after) in PROBE_TARGETS.items():
        result = F.when(probe == name, F.concat(F.lit(before), address, F.lit(after))).otherwise(result)
    return result


def probe_targets(devices: DataFrame) -> DataFrame:
    """One row per device and probe; a device that names no probe is pinged."""
    exploded = _addressed(devices).withColumn("probe", F.explode(_probes()))
    return exploded.select(
        "id",
        "probe",
        F.array(probe_target(F.col("primary_ip_address"), F.col("probe"))).alias("targets"),
        label_map(PROBE_LABELS, {"__param_module": F.col("probe")}).alias("labels"),
    )


def target_documents(probes: DataFrame, per_document: int = 500) -> DataFrame:
    """JSON documents per probe. Each covers a span of device ids, so its size is bounded
    however large the inventory is; the documents of a probe together are its target list."""
    part = F.floor(F.col("id") / per_document).cast("long").alias("part")
    item = F.struct("id", F.to_json(F.struct("targets", "labels")).alias("text")).alias("item")
    texts = F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"])
    grouped = probes.select("probe", part, item).groupBy("probe", "part").agg(texts.alias("texts"))
    return grouped.select(
        "probe", "part", F.size("texts").cast("long").alias("target_count"),
        F.concat(F.lit("["), F.concat_ws(",", "texts"), F.lit("]")).alias("document"),
    )


def sync_stats(devices: DataFrame) -> DataFrame:
    """Devices and targets of one synchronisation, in one pass."""
    addressed = F.coalesce("primary_ip_address", F.lit("")) != ""
    return devices.agg(
        F.count(F.lit(1)).alias("devices_total"),
        F.count_if(addressed & F.col("custom_fields.gnmi_enabled")).alias("gnmi_targets"),
        F.count_if(addressed & F.col("custom_fields.snmp_enabled")).alias("snmp_targets"),
        F.coalesce(F.sum(F.when(addressed, F.size(_probes()))), F.lit(0)).alias("blackbox_targets"),
    )


def sync_runs(runs: DataFrame) -> DataFrame:
    """Last success, its duration and the error count of a log of synchronisations.

    runs: started, finished (timestamps), ok.
    """
    ok = F.col("ok")
    seconds = (F.unix_micros("finished") - F.unix_micros("started")) / F.lit(1e6)
    return runs.agg(
        F.max(F.when(ok, F.col("finished"))).cast("timestamp_ntz").alias("last_success_at"),
        F.max_by(F.when(ok, seconds), F.when(ok, F.col("finished"))).alias("last_duration_s"),
        F.count_if(~ok).alias("errors_total"),
        F.count(F.lit(1)).alias("runs_total"),
    )


def target_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What a synchronisation would add, remove or change; equal rows are left out."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.select(key, F.to_json(F.struct(*rest)).alias(name))

    joined = packed(old, "before").join(packed(new, "after"), key, "full")
    change = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "changed")
    )
    return joined.withColumn("change", change).where(F.col("change").isNotNull())
