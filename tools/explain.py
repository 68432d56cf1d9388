"""Print the physical plan of registered queries: python tools/explain.py [sf_dir] name ..."""

import sys

sys.path.insert(0, ".")
from lodgelake.plans.registry import QUERIES  # noqa: E402
from lodgelake.session import build_session  # noqa: E402

args = sys.argv[1:]
sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.1"
spark = build_session("local[8]", shuffle_partitions=16)
for name in args:
    print(f"===== {name}")
    QUERIES[name](spark, sf_dir).explain("formatted" if "--formatted" in sys.argv else None)
