"""python -m reportlake.cli INPUT [-o OUTPUT] [--format pdf|text|tables] [--schema FILE]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from reportlake.plans.catalogue import DEFAULT, load
from reportlake.plans.pipeline import extract_kpis
from reportlake.sources import reports, results


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="reportlake", description="Extract key figures from reports as JSON.")
    p.add_argument("input", help="file, folder or glob of reports")
    p.add_argument("-o", "--output", help="folder for the JSON lines; printed where absent")
    p.add_argument("--format", choices=("pdf", "text", "tables"), default="pdf")
    p.add_argument("--schema", help="JSON file of indicators with their units and synonyms")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    read = {"pdf": reports.read_pdf, "text": reports.read_text, "tables": reports.read_tables}[args.format]
    found = extract_kpis(read(spark, args.input), load(args.schema) if args.schema else DEFAULT)
    if args.output:
        results.write_json(found, args.output)
    else:
        for row in results.as_json(found).toLocalIterator():
            print(row["json"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
