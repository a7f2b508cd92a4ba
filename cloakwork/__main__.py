"""Command line: scan, audit, mask, scan-dir, mask-dir, db-scan, db-audit, db-mask, guard and list-patterns.

Exit codes: 0 nothing found (or written), 1 findings, 2 an error; guard gives 0 allowed,
3 approval required, 4 blocked.
"""

from __future__ import annotations

import argparse
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect, mask, report
from .plans import guard
from .registry import DETECTORS
from .session import local_session, ship_code
from .sinks import reports
from .sources import database, files

GUARD_EXIT = {"ALLOW": 0, "ALLOW_WITH_TRANSFORMATION": 0, "REQUIRE_APPROVAL": 3, "BLOCK": 4}
#: Lines that audits print at most; the rest is in ``--output``.
PRINTED = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cloakwork", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "audit", "mask", "scan-dir", "mask-dir", "guard"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--exclude", action="append", default=[])
        c.add_argument("--ext", action="append", default=[])
        _common(c)
        if name == "scan-dir":
            c.add_argument("-f", "--format", choices=("markdown", "html", "json"), default="markdown")
            c.add_argument("--lang", choices=("en", "ar"), default="en")
        if name == "guard":
            for flag in ("agent", "task", "destination"):
                c.add_argument(f"--{flag}", default="" if flag == "task" else "unknown")
            c.add_argument("--approve", action="store_true")
            c.add_argument("--max-iterations", type=int, default=4)
    for name in ("db-scan", "db-audit", "db-mask"):
        c = commands.add_parser(name)
        c.add_argument("connection")
        c.add_argument("-q", "--query", default="")
        c.add_argument("--limit", type=int, default=database.DEFAULT_LIMIT)
        c.add_argument("-f", "--format", choices=("json", "csv", "parquet"), default="json")
        _common(c)
    commands.add_parser("list-patterns")
    return p


def _common(c: argparse.ArgumentParser) -> None:
    c.add_argument("-m", "--mode", choices=mask.MODES, default="typed")
    c.add_argument("-w", "--whitelist", default="")
    c.add_argument("-o", "--output")


def folder_texts(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Texts of a file or of all files below a folder; folders follow their ignore file."""
    lines = list(o.exclude)
    for name in (".gitignore",):
        at = os.path.join(o.path, name)
        if os.path.isfile(at):
            with open(at, encoding="utf-8") as f:
                lines += f.read().splitlines()
    return files.texts(files.read_folder(spark, o.path, lines, o.ext))


def show(found: DataFrame, values: bool) -> int:
    """Counts, and the findings themselves for audits; 1 if there are any."""
    totals = report.by_category(found).first()
    print(f"{totals.total} finding(s): {totals.n_id} ID & docs, {totals.n_pii} personal info, {totals.n_cred} credentials")
    if values:
        for r in found.orderBy("source", "start").limit(PRINTED).toLocalIterator():
            print(f"{r.source}:{r.line}\t{r.id}\t{r.original}")
    return int(totals.total > 0)


def on_files(spark: SparkSession, o: argparse.Namespace, white: tuple[str, ...]) -> int:
    texts = folder_texts(spark, o)
    broken = texts.where("error is not null").count()
    if broken:
        print(f"{broken} file(s) could not be read", file=sys.stderr)
    good = texts.where("error is null").select(F.col("path").alias("source"), "text")
    if o.command in ("mask", "mask-dir"):
        masked = mask.mask(good, "source", mode=o.mode, whitelist=white, scope="dataset")
        masked.select(files.output_path(F.col("source")).alias("path"), F.col("masked").alias("text")).write.mode("overwrite").parquet(o.output or o.path.rstrip("/") + "_masked")
        return 0
    if o.command == "guard":
        c = guard.Context(o.agent, o.destination, o.task, o.max_iterations, o.approve)
        decided = guard.decide(good, "source", c)
        if o.output:
            reports.audit(decided, "source", o.output)
        counts = dict(map(tuple, decided.groupBy("decision").count().collect()))
        print(", ".join(f"{k}: {n}" for k, n in sorted(counts.items())))
        return max((GUARD_EXIT[k] for k in counts), default=0)
    found = detect.findings(good, "source", whitelist=white)
    if o.command == "scan-dir" and o.output:
        reports.write(found, "source", o.output, o.format, o.lang)
    return show(found, o.command == "audit") or (2 if broken else 0)


def on_database(spark: SparkSession, o: argparse.Namespace, white: tuple[str, ...]) -> int:
    rows = database.read(spark, o.connection, o.query, o.limit).withColumn("__row", F.monotonically_increasing_id())
    columns = [n for n, t in rows.dtypes if t == "string"]
    if o.command == "db-mask":
        masked = mask.mask_columns(rows, columns, "__row", o.mode) if columns else rows
        masked.drop("__row").write.mode("overwrite").format(o.format).save(o.output or "masked_query")
        return 0
    parts = [rows.select(F.concat(F.lit(f"{c}:"), F.col("__row").cast("string")).alias("source"), F.col(c).alias("text")) for c in columns]
    if not parts:
        return 0
    return show(detect.findings(reduce(DataFrame.unionByName, parts), "source", whitelist=white), o.command == "db-audit")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(arguments)
    if o.command == "list-patterns":
        for d in DETECTORS:
            print(f"{d.id}\t{d.category}\t{d.severity}\t{d.label}")
        return 0
    spark = ship_code(spark or local_session("command"))
    white = tuple(w.strip() for w in o.whitelist.split(",") if w.strip())
    try:
        return on_database(spark, o, white) if o.command.startswith("db-") else on_files(spark, o, white)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
