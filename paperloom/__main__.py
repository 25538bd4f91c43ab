"""``python -m paperloom crawl|archive|verify|batch|analyze|view|authors``: jobs over stored tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from paperloom import jobs, schemas, sources
from paperloom.functions.detection import SECTION_IDS
from paperloom.storage import workers_find_package


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("crawl", help="calls, editions and errors from a table of pages")
    c.add_argument("pages", help="Parquet of url, html")
    c.add_argument("listed", help="JSON lines of series, edition, url")
    c.add_argument("scope", help="JSON: base, hosts, archives, ...")
    c.add_argument("output")
    c.add_argument("--series", nargs="*", default=[])
    c.add_argument("--years", nargs="*", type=int, default=[])
    c.add_argument("--snapshots", help="pattern of snapshot logs")
    b = commands.add_parser("batch", help="results and year summaries of a corpus")
    b.add_argument("extracted", help="JSON lines of extracted documents")
    b.add_argument("conference")
    b.add_argument("output")
    b.add_argument("--annotations", help="JSON map of reviews by file")
    b.add_argument("--wrong-files", help="JSON lines of file")
    b.add_argument("--excluded", help="JSON lines of file, id, heading, page")
    a = commands.add_parser("analyze", help="statements, identifiers and links as JSON lines")
    a.add_argument("extracted")
    a.add_argument("output")
    v = commands.add_parser("archive", help="what is left to capture, and calls with newer snapshots")
    v.add_argument("report")
    v.add_argument("attempts", help="pattern of snapshot logs")
    v.add_argument("scope", help="JSON: base, hosts, archives, ...")
    v.add_argument("output")
    v.add_argument("--pages", help="Parquet of url, html")
    v.add_argument("--series", nargs="*", default=[])
    v.add_argument("--force", action="store_true")
    f = commands.add_parser("verify", help="calls whose snapshot doesn't play")
    f.add_argument("report")
    f.add_argument("responses", help="JSON lines of snapshot_url, status, body")
    f.add_argument("output")
    w = commands.add_parser("view", help="cards, matrices and chart as tables")
    w.add_argument("report")
    w.add_argument("output")
    w.add_argument("--summaries", nargs="*", default=[])
    w.add_argument("--main-series", nargs="*", default=[])
    w.add_argument("--since", nargs="*", default=[], metavar="SERIES=YEAR")
    u = commands.add_parser("authors", help="papers and available papers by author")
    for name in ("authors", "summary", "annotations", "output"):
        u.add_argument(name)
    for p in (b, a):
        p.add_argument("--sections", default=",".join(SECTION_IDS), help="ids separated by commas; unknown ones are ignored")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    told = arguments(argv)
    spark = SparkSession.builder.appName(f"paperloom {told.command}").getOrCreate()
    workers_find_package(spark)
    if told.command == "crawl":
        listed = spark.read.schema(jobs.LISTED).json(told.listed)
        known = sources.read_snapshots(spark, told.snapshots) if told.snapshots else None
        jobs.crawl_job(spark, spark.read.parquet(told.pages), listed, jobs.read_scope(spark, told.scope), told.output, snapshots=known, series=told.series, years=told.years)
        return
    if told.command == "archive":
        pages = spark.read.parquet(told.pages) if told.pages else None
        jobs.archive_job(spark, told.report, told.attempts, told.output, jobs.read_scope(spark, told.scope), pages=pages, series=told.series, force=told.force)
        return
    if told.command == "verify":
        jobs.verify_job(spark, told.report, spark.read.schema(schemas.RESPONSES).json(told.responses), told.output)
        return
    if told.command == "view":
        since = {k: int(y) for k, y in (x.split("=") for x in told.since)}
        jobs.view_job(spark, told.report, told.summaries, told.output, main=told.main_series, since=since)
        return
    if told.command == "authors":
        jobs.authors_job(spark, told.authors, told.summary, told.annotations, told.output)
        return
    docs, ids = jobs.read_extracted(spark, told.extracted), tuple(filter(None, told.sections.split(",")))
    if told.command == "analyze":
        jobs.analyze_job(docs, ids).write.mode("overwrite").text(told.output)
        return
    notes = sources.read_annotations(spark, told.annotations) if told.annotations else None
    wrong = spark.read.schema("file STRING").json(told.wrong_files) if told.wrong_files else None
    out = spark.read.schema(jobs.EXCLUDED).json(told.excluded) if told.excluded else None
    jobs.batch_job(spark, docs, told.conference, told.output, annotations=notes, wrong_files=wrong, excluded=out, ids=ids)


if __name__ == "__main__":
    main()
