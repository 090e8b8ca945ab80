"""python -m loomwright: list the registered queries, run one, or print its plan."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from . import catalogue

    p = argparse.ArgumentParser(prog="loomwright", description=__doc__)
    p.add_argument("query", nargs="?", help="a query's name; none lists them")
    p.add_argument("folder", nargs="?", help="the folder of the tables")
    p.add_argument("--explain", action="store_true", help="print the plan instead of running")
    p.add_argument("--out", help="write Parquet there instead of printing rows")
    p.add_argument("--rows", type=int, default=20, help="rows to print")
    a = p.parse_args(argv)
    names = catalogue.queries()
    if not a.query:
        print("\n".join(names))
        return
    if a.query not in names or not a.folder:
        p.error("give the name of a query, and a folder")
    from pyspark.sql import SparkSession

    df = names[a.query](SparkSession.builder.getOrCreate(), a.folder)
    if a.explain:
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
