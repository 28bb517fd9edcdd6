"""Command line: run registered queries and the checkout job.

    python -m marketlane list
    python -m marketlane run <query> --data DIR --out PATH
    python -m marketlane checkout --data DIR --out ROOT --version N [--strict]

On a cluster, submit with spark-submit; settings the cluster provides are kept.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="marketlane")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    r = sub.add_parser("run", help="run one registered query and write it as parquet")
    r.add_argument("query")
    r.add_argument("--data", required=True)
    r.add_argument("--out", required=True)
    c = sub.add_parser("checkout", help="run whole-batch checkout and write all outputs as one version")
    c.add_argument("--data", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--version", type=int, required=True)
    c.add_argument("--strict", action="store_true")
    args = p.parse_args(argv)

    from .plans.registry import queries

    if args.cmd == "list":
        for name in sorted(queries()):
            print(name)
        return 0

    from .session import build_session

    spark = build_session()
    try:
        if args.cmd == "run":
            qs = queries()
            if args.query not in qs:
                print(f"unknown query {args.query!r}", file=sys.stderr)
                return 2
            qs[args.query](spark, args.data).write.mode("overwrite").parquet(args.out)
        else:
            from .plans.checkout import bulk_checkout, checkout_requests_with_codes, write_checkout
            from .plans.registry import AS_OF, NOW
            from .sources.tables import ShopTables

            t = ShopTables(spark, args.data)
            res = bulk_checkout(t, checkout_requests_with_codes(t), AS_OF, NOW, strict=args.strict)
            print(write_checkout(res, args.out, args.version))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
