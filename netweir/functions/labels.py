"""Label sets of time series.

Maps cannot be join keys and have no stable order, so a series is identified by
``series_key``: the JSON text of its labels in name order, without the metric name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_key(labels: Column, drop: list[str] | None = None) -> Column:
    """Identity of a label set; an empty label counts as absent."""
    dropped = drop or []

    def keep(name: Column, value: Column) -> Column:
        return (value != "") & ~name.isin(dropped) if dropped else value != ""

    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(labels, keep)))))


def label(key: Column, name: str) -> Column:
    """One label out of a series key, '' if the series does not carry it."""
    return F.coalesce(F.get_json_object(key, f"$.{name}"), F.lit(""))


def labels_of(key: Column) -> Column:
    return F.from_json(key, "map<string,string>")


def equals(labels: Column, name: str, value: str) -> Column:
    """Matcher ``name = value``; a missing label equals ''."""
    return F.coalesce(labels.getItem(name), F.lit("")) == value


def matches(labels: Column, name: str, pattern: str) -> Column:
    """Matcher ``name =~ pattern``; the pattern has to match the whole value."""
    return F.coalesce(labels.getItem(name), F.lit("")).rlike(f"^(?:{pattern})$")


def any_of(values: list[str] | None) -> str:
    """Pattern of a multi-value dashboard variable; None stands for all values."""
    return ".*" if values is None else "|".join(values)


def rename_metric(metric: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(metric, pattern, replacement)


def copy_label(labels: Column, source: str, target: str) -> Column:
    """The label set with ``target`` set to the value of ``source``, where it has one."""
    rest = F.map_filter(labels, lambda k, _: k != target)
    copied = F.map_concat(rest, F.create_map(F.lit(target), labels.getItem(source)))
    return F.when(F.coalesce(labels.getItem(source), F.lit("")) != "", copied).otherwise(labels)
