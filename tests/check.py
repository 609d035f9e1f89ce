"""Run queries against their SQL: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, difference

import __spark_entry__ as entry
from netweir.session import local_session


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark, con = local_session("8"), connect(sf_dir)
    queries, texts = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in texts:
                problem, info = difference(df, con, texts[name])
            else:
                problem, info = None, f"rows {df.count()} (no SQL)"
        except Exception as exc:
            problem, info = f"{type(exc).__name__}: {str(exc)[:900]}", ""
            if wanted:
                traceback.print_exc()
        print(f"{time.time() - t0:6.2f}", ("ok  " if problem is None else "BAD ") + name, info, problem or "", flush=True)
        if problem:
            bad.append(name)
    print("FAILED:" if bad else "all ok", bad)


main()
