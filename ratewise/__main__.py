"""Command line: ``python -m ratewise`` (or ``spark-submit ratewise/__main__.py``).

    python -m ratewise list
    python -m ratewise run m11_als_report /data/sf1 --show 20
    python -m ratewise run m21_densify_entries /data/sf1 --out /shared/out/entries

``--out`` writes the result as parquet from the executors (nothing is
collected); ``--show`` prints a bounded preview.  Without ``--master`` the
master comes from spark-submit / the cluster configuration.
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv=None) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    p = argparse.ArgumentParser(prog="ratewise")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    r = sub.add_parser("run", help="run one registered query")
    r.add_argument("query")
    r.add_argument("data_dir")
    r.add_argument("--out", help="write the result as parquet to this path")
    r.add_argument("--show", type=int, default=20, help="rows to preview when --out is not given")
    r.add_argument("--master", default=None)
    r.add_argument("--partitions", type=int, default=200)
    a = p.parse_args(argv)

    from ratewise.plans import catalog

    if a.cmd == "list":
        for k in sorted(catalog.QUERIES):
            print(k, "(oracle)" if k in catalog.ORACLE else "")
        return 0

    from ratewise.session import clean_up, get_session

    if a.query not in catalog.QUERIES:
        print(f"unknown query {a.query!r}; see `python -m ratewise list`", file=sys.stderr)
        return 2
    spark = get_session(a.master, partitions=a.partitions, app=f"ratewise-{a.query}")
    try:
        df = catalog.QUERIES[a.query](spark, a.data_dir)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
            print(f"wrote {a.out}")
        else:
            df.show(a.show, truncate=False)
    finally:
        clean_up(spark)
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
