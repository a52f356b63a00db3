"""Command line: load tables once, build the order view once, write reports.

    python -m cxlens load   --csv DIR | --fixture SF_DIR   --warehouse WH
    python -m cxlens view   --warehouse WH [--by-month | --incremental] [--salted]
    python -m cxlens report --warehouse WH [--out OUT] [--show] [NAME ...]

Tables and the view are Parquet folders under the warehouse path (any file
system Spark reads); report results go to ``OUT/<name>`` as Parquet. A load
goes to a folder of its own and counts from when it is complete; the view lies
beside the tables it was built from, so a new load never meets an old view.
An incremental view lives in a store of the warehouse and is shared by its loads.
The session is sized from the bytes at hand and the cores it has.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from cxlens.session import RECOMMENDED_CONF, ensure_checkpoint_dir
    builder = SparkSession.builder.appName("cxlens")
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _sized(spark: SparkSession, path: str, cores: int | None) -> None:
    from cxlens.session import apply_cluster_conf
    from cxlens.sources.files import file_statuses
    apply_cluster_conf(spark, sum(size for _, size, _ in file_statuses(spark, path)), cores)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cxlens")
    p.add_argument("--cores", type=int, help="cores to size partitions for (default: what the session reports)")
    sub = p.add_subparsers(dest="cmd", required=True)
    load = sub.add_parser("load")
    src = load.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv")
    src.add_argument("--fixture")
    load.add_argument("--warehouse", required=True)
    view = sub.add_parser("view")
    view.add_argument("--warehouse", required=True)
    how = view.add_mutually_exclusive_group()
    how.add_argument("--by-month", action="store_true", help="one folder for each month")
    how.add_argument("--incremental", action="store_true", help="rebuild only the months in which an order differs from the last incremental view")
    view.add_argument("--salted", action="store_true", help="one order may have a large share of all reviews")
    rep = sub.add_parser("report")
    rep.add_argument("--warehouse", required=True)
    rep.add_argument("--out")
    rep.add_argument("--show", action="store_true", help="print every row")
    rep.add_argument("names", nargs="*")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)

    from cxlens.plans import all_reports
    from cxlens.plans.order_view import materialize_order_view, read_order_view
    from cxlens.plans.view_store import ViewStore
    from cxlens.sources import (derive_marketplace, load_csv_tables, read_parquet_tables,
                                write_tables)
    from cxlens.sources.files import commit_set, fresh_folder, join_path, latest_set

    spark = _session()
    loads = join_path(args.warehouse, "loads")
    if args.cmd == "load":
        _sized(spark, args.csv or args.fixture, args.cores)
        t = load_csv_tables(spark, args.csv) if args.csv else derive_marketplace(spark, args.fixture)
        folder = fresh_folder(loads)
        write_tables(t, join_path(folder, "tables"), concurrent_jobs=4)
        for name, df in read_parquet_tables(spark, join_path(folder, "tables")).items():
            print(f"{name}: {df.count()} rows")
        commit_set(spark, join_path(args.warehouse, "complete"), folder)
        return 0
    folder = latest_set(spark, join_path(args.warehouse, "complete"))
    if folder is None:
        print(f"nothing is loaded in {args.warehouse}", file=sys.stderr)
        return 2
    tables_dir = join_path(folder, "tables")
    _sized(spark, tables_dir, args.cores)
    t = read_parquet_tables(spark, tables_dir)
    views = join_path(folder, "views")
    store = ViewStore(spark, join_path(args.warehouse, "view-store"))
    if args.cmd == "view" and args.incremental:
        done = store.refresh(t)
        print(f"rebuilt {len(done.rebuilt)} months, dropped {len(done.dropped)}")
        commit_set(spark, join_path(folder, "complete-views"), done.folder)
        return 0
    if args.cmd == "view":
        view_dir = fresh_folder(views)
        materialize_order_view(t, view_dir, ("order_month",) if args.by_month else (), salted=args.salted)
        commit_set(spark, join_path(folder, "complete-views"), view_dir)
        return 0
    reports = all_reports()
    unknown = [n for n in args.names if n not in reports]
    if unknown:
        print(f"unknown reports: {unknown}", file=sys.stderr)
        return 2
    view_dir = latest_set(spark, join_path(folder, "complete-views"))
    view_df = None
    if view_dir:
        view_df = store.read(view_dir) if view_dir.startswith(store.path + "/") else read_order_view(spark, view_dir)
    for name in args.names or sorted(reports):
        df = reports[name].run(t, view_df)
        if args.out:
            df.write.mode("overwrite").parquet(join_path(args.out, name))
        if args.show:
            print(f"== {name}")
            print("\t".join(df.columns))
            for row in df.toLocalIterator():
                print("\t".join("" if x is None else str(x) for x in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
