"""Command line: ``python -m bazaar <command>`` (or through spark-submit).

    clean    yearly CSV files -> cleaned, year-partitioned Parquet table
    report   one named report over a cleaned table (printed, or written as CSV)
    list     the report names
    to-jdbc  append a cleaned table to a database table
"""

from __future__ import annotations

import argparse
import os
import sys


#: Reports are short; unless told otherwise all their rows are printed.
ALL_ROWS = 1_000_000_000


def _value(text: str):
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for cast in (int, float):
        try:
            return cast(text)
        except ValueError:
            pass
    return text


def _params(pairs: list[str]) -> dict:
    out = {}
    for p in pairs:
        key, _, val = p.partition("=")
        if not key or not _:
            raise SystemExit(f"--param needs key=value, got {p!r}")
        out[key] = _value(val)
    return out


def build_parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="python -m bazaar", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--master", help="e.g. local[8]; leave unset under spark-submit")
    sub = ap.add_subparsers(dest="command", required=True)

    c = sub.add_parser("clean", help="clean yearly CSV files into a Parquet table")
    c.add_argument("--input", nargs="+", required=True, help="CSV files or folders, in year order")
    c.add_argument("--output", required=True)
    c.add_argument("--delivery-mode", choices=["observed", "intended"], default="observed")
    c.add_argument("--multiline", action="store_true",
                   help="quoted text may hold line breaks (each file is then read by one task)")
    c.add_argument("--csv-output", help="also write the clean rows as header CSV here")

    r = sub.add_parser("report", help="run one report over a cleaned table")
    r.add_argument("name")
    r.add_argument("--input", required=True, help="cleaned Parquet table")
    r.add_argument("--param", action="append", default=[], help="report parameter key=value")
    r.add_argument("--output", help="write the rows as header CSV instead of printing")
    r.add_argument("--show", type=int, help="print only so many rows (default: all)")

    sub.add_parser("list", help="list report names")

    j = sub.add_parser("to-jdbc", help="append a cleaned table to a database table")
    j.add_argument("--input", required=True)
    j.add_argument("--url", required=True)
    j.add_argument("--table", required=True)
    j.add_argument("--user")
    j.add_argument("--password-env", help="name of the environment variable holding the password")
    j.add_argument("--mode", choices=["append", "overwrite"], default="append")
    j.add_argument("--max-connections", type=int)
    return ap


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from bazaar.plans.reports import REPORTS, report

    if args.command == "list":
        print("\n".join(sorted(REPORTS)))
        return 0

    from pyspark.sql import Observation

    from bazaar.session import build_session, clear_scratch
    from bazaar.sources import csv_io, sinks
    from bazaar.operators import clean, typing

    spark = build_session(master=args.master, app=f"bazaar-{args.command}")
    if args.command == "clean":
        bronze = csv_io.read_yearly_csv(spark, args.input, multiline=args.multiline)
        malformed = Observation("csv")
        bronze = bronze.observe(malformed, csv_io.corrupt_rows(bronze))
        try:
            silver = clean.clean_pipeline(bronze, csv_io.source_order(bronze), args.delivery_mode)
            sinks.write_parquet(typing.derive_calendar(silver), args.output)
            if args.csv_output:
                # The cleaned columns alone: calendar columns belong to the Parquet table.
                sinks.write_csv(spark.read.parquet(args.output).select(*silver.columns), args.csv_output)
        finally:
            clear_scratch(spark)
        print(f"rows with a wrong number of fields: {malformed.get['corrupt_rows']}")
        return 0
    facts = spark.read.parquet(args.input)
    if args.command == "report":
        out = report(args.name, typing.load_view(facts), **_params(args.param))
        if args.output:
            sinks.write_csv(out, args.output)
        else:
            out.show(ALL_ROWS if args.show is None else args.show, truncate=False)
        return 0
    if args.command == "to-jdbc":
        password = os.environ.get(args.password_env) if args.password_env else None
        sinks.write_jdbc(facts, args.url, args.table, mode=args.mode,
                         max_connections=args.max_connections, user=args.user, password=password)
        return 0
    return 2


if __name__ == "__main__":
    sys.exit(main())
