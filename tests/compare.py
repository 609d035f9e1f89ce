"""Compare a Spark query with its SQL on the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


# With CHECK_STRICT set, doubles have to agree in every bit.
STRICT = bool(os.environ.get("CHECK_STRICT"))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value) if STRICT else f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (int,)):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def type_differences(spark_types, duck_types):
    return {c: (t, duck_types[c]) for c, t in spark_types.items() if SAME_TYPE.get(t) != duck_types[c]}


def difference(df, con, text):
    """None when equal, else a short description."""
    t0 = time.time()
    table = df.toArrow()
    got_cols = table.column_names
    got = rows_of(got_cols, zip(*[c.to_pylist() for c in table.columns])) if got_cols else []
    t1 = time.time()
    cur = con.execute(text)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    t2 = time.time()
    info = f"rows {len(got)} spark {t1 - t0:.2f}s duckdb {t2 - t1:.2f}s"
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}", info
    if len(got) != len(want):
        return f"row count {len(got)} != {len(want)}: {set(got) ^ set(want) and list(set(got) ^ set(want))[:4]}", info
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"values: spark {only_got} sql {only_want} cols {sorted(got_cols)}", info
    mismatched = type_differences(dict(df.dtypes), {d[0]: str(d[1]) for d in cur.description})
    return None, info + (" EMPTY" if not got else "") + (f" TYPES {mismatched}" if mismatched else "")
