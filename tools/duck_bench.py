"""Single-node reference timing: the oracle SQL of the headline queries in DuckDB (median of N runs).

usage: python tools/duck_bench.py [sf_dir] [runs]
"""

import json
import statistics
import sys
import time

import duckdb

sys.path.insert(0, ".")
from bench import HEADLINE  # noqa: E402
from lodgelake.plans.registry import ORACLE  # noqa: E402
from lodgelake.sources.tables import DRIVER_TABLES  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
runs = int(sys.argv[2]) if len(sys.argv) > 2 else 5
con = duckdb.connect()
con.sql("SET threads = 8")
for t in DRIVER_TABLES:
    con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
times = {}
for name in HEADLINE:
    # full execution materialised inside the engine (the counterpart of Spark's noop sink)
    sql = f"CREATE OR REPLACE TEMP TABLE bench_out AS {ORACLE[name]}"
    con.execute(sql)
    ts = []
    for _ in range(runs):
        t0 = time.perf_counter()
        con.execute(sql)
        ts.append(time.perf_counter() - t0)
    times[name] = round(statistics.median(ts), 4)
print(json.dumps({"engine": "duckdb", "value": round(sum(times.values()), 4), "queries": times}))
