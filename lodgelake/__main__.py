"""Command line: run registered queries.

  python -m lodgelake list
  python -m lodgelake show NAME [--sf-dir DIR] [--rows N]
  python -m lodgelake write NAME OUT_PATH [--sf-dir DIR] [--format parquet|json|csv]
  python -m lodgelake explain NAME [--sf-dir DIR]
"""

from __future__ import annotations

import argparse
import sys

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodgelake", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    for name in ("show", "write", "explain"):
        s = sub.add_parser(name)
        s.add_argument("query")
        if name == "write":
            s.add_argument("out")
            s.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
        s.add_argument("--sf-dir", default=DEFAULT_SF_DIR)
        s.add_argument("--rows", type=int, default=20)
        s.add_argument("--master", default=None, help="e.g. local[8]; omit under spark-submit")
    args = p.parse_args(argv)

    from lodgelake.plans.registry import ORACLE, QUERIES

    if args.cmd == "list":
        try:
            for name in sorted(QUERIES):
                print(f"{name}{'' if name in ORACLE else '  (no oracle SQL)'}")
        except BrokenPipeError:  # output piped into head & co.
            pass
        return 0
    if args.query not in QUERIES:
        print(f"unknown query {args.query!r}; see `python -m lodgelake list`", file=sys.stderr)
        return 2

    from lodgelake.session import build_session

    spark = build_session(args.master)
    df = QUERIES[args.query](spark, args.sf_dir)
    if args.cmd == "show":
        df.show(args.rows, truncate=False)
    elif args.cmd == "explain":
        df.explain("formatted")
    else:
        df.write.mode("errorifexists").format(args.format).save(args.out)
        print(f"wrote {args.query} to {args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
