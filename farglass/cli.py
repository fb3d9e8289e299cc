"""Command-line drivers for series and trends.

    python -m farglass.cli companies --companies C --rounds R --out O [--period month] [--by industry]
    python -m farglass.cli projects --projects P --out O [--period year] [--by category]
    python -m farglass.cli trends --series S --value raised --out O [--by industry] [--first 2016] [--last 2020]

Each is one job over all categories; with ``--by`` its result is partitioned by the category. Tables
are read by their suffix (Parquet, CSV or JSON).
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from farglass.operators import funding, series
from farglass.runtime import session
from farglass.sources import tables


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="farglass", description="Series and trends of funding and research.")
    kinds = made.add_subparsers(dest="kind", required=True)

    def kind(name: str, inputs: Sequence[str]) -> argparse.ArgumentParser:
        added = kinds.add_parser(name)
        for x in inputs:
            added.add_argument(f"--{x}", required=True)
        added.add_argument("--out", required=True)
        added.add_argument("--by", help="category column: one series for each value")
        added.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
        return added

    for name, inputs in (("companies", ("companies", "rounds")), ("projects", ("projects",))):
        added = kind(name, inputs)
        added.add_argument("--period", choices=tuple(series.MONTHS), default="year")
        added.add_argument("--first", type=int, default=2007)
        added.add_argument("--last", type=int, default=2022)
    added = kind("trends", ("series",))
    added.add_argument("--value", required=True)
    added.add_argument("--first", type=int, default=2017)
    added.add_argument("--last", type=int, default=2021)
    added.add_argument("--window", type=int, default=3)
    return made


def result(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    by = [given.by] if given.by else []
    if given.kind == "projects":
        return funding.project_series(tables.read_any(spark, given.projects), given.period, given.first, given.last, by)
    if given.kind == "companies":
        companies, rounds = tables.read_any(spark, given.companies), tables.read_any(spark, given.rounds)
        if by and given.by not in rounds.columns:
            rounds = rounds.join(companies.select(companies["id"].alias("org_id"), given.by), "org_id")
        return funding.company_series(companies, rounds, given.period, given.first, given.last, by)
    rows = tables.read_any(spark, given.series)
    rows = rows if "year" in rows.columns else rows.selectExpr("*", "year(period) as year")
    found = series.magnitude_and_growth(rows, given.value, given.first, given.last, given.window, by)
    return series.trend_type(found, "magnitude", "smoothed_growth")


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parser().parse_args(arguments)
    rows = result(spark or session("farglass"), given)
    tables.write_table(rows, given.out, kind=given.format, partition_by=[given.by] if given.by and given.kind != "trends" else [])


if __name__ == "__main__":
    main()
