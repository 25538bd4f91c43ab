"""The application's end-to-end jobs over stored tables. Each writes what it finds below its ``out``."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas, sources
from paperloom.functions import textnorm as T
from paperloom.functions.detection import SECTION_IDS
from paperloom.operators import crawl as C
from paperloom.operators import documents as D
from paperloom.operators import summary as S
from paperloom.operators import views as V
from paperloom.storage import cut

EXCLUDED = "file STRING, id STRING, heading STRING, page INT"
LISTED = "series STRING, edition STRING, url STRING"


def scope_of(told: dict) -> C.Scope:
    """A crawl's scope from its JSON form."""
    sets = {k: frozenset(told.get(k, ())) for k in ("hosts", "archives", "keep_slash", "call_hosts")}
    return C.Scope(told["base"], **sets, queries=frozenset(map(tuple, told.get("queries", ()))), research_titles=tuple(told.get("research_titles", ())), canonical=dict(told.get("canonical", {})))


def crawl_job(spark: SparkSession, pages: DataFrame, listed: DataFrame, scope: C.Scope, out: str, *, snapshots: DataFrame | None = None, seeds: DataFrame | None = None, series: Sequence[str] = (), years: Sequence[int] = (), homes: DataFrame | None = None) -> None:
    """From pages (url, html) and listed editions to ``out``/calls, editions, errors, report and csv.

    ``homes`` (series, year, url) are candidates that take the place of listed addresses if their page is titled so.
    """
    began = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = listed if seeds is None else listed.unionByName(seeds)
    parsed = cut(C.parse_pages(pages, scope), "parsed")
    found = None if homes is None else C.verified_homes(homes, parsed)
    starts = cut(C.editions(rows.filter(F.col("series").isin(*series)) if series else rows, None, scope, years, found), "editions")
    visited = cut(C.crawl(starts, parsed, scope), "visited")
    known = spark.createDataFrame([], "url STRING, snapshot_url STRING") if snapshots is None else snapshots
    calls = cut(C.call_records(visited, parsed, known, scope), "calls")
    names = list(series) or [r["series"] for r in rows.select("series").distinct().orderBy("series").collect()]
    sources.write_report(out, calls, C.edition_report(starts, visited, calls), C.errors(visited), names, list(years) or None, began)
    sources.write_calls_csv(f"{out}/csv", calls)


def batch_job(spark: SparkSession, extracted: DataFrame, conference: str, out: str, *, annotations: DataFrame | None = None, wrong_files: DataFrame | None = None, excluded: DataFrame | None = None, detector: str = "paperloom", ids: Sequence[str] = SECTION_IDS) -> None:
    """From extracted documents to ``out``/files (a row per document), papers (a row per paper and list), counts, summary (a row per year), and public (one JSON document)."""
    results = cut(D.file_results(D.analyze_documents(extracted, ids), excluded), "results")
    notes = spark.createDataFrame([], f"file STRING, annotation {schemas.ANNOTATION}") if annotations is None else annotations
    wrong = spark.createDataFrame([], "file STRING") if wrong_files is None else wrong_files
    rows = cut(S.reviewed(results, notes, wrong, conference), "reviewed")
    S.summary_rows(rows).write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/papers")
    S.year_counts(rows).write.mode("overwrite").json(f"{out}/counts")
    summary = cut(S.year_summary(rows), "summary")
    results.write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/files")
    summary.write.mode("overwrite").json(f"{out}/summary")
    S.public_envelope(summary, conference, detector).write.mode("overwrite").text(f"{out}/public")


def archive_job(spark: SparkSession, report: str, attempts: str, out: str, scope: C.Scope, *, pages: DataFrame | None = None, series: Sequence[str] = (), force: bool = False) -> None:
    """From a report and the log of attempts to ``out``/to_capture and a re-synchronised report with its tables."""
    calls = sources.read_calls(spark, report)
    snapshots = sources.read_snapshots(spark, attempts)
    wanted = calls.filter(F.col("series").isin(*series)) if series else calls
    done = snapshots.select("url", "snapshot_url").unionByName(calls.select("url", "snapshot_url"))
    C.to_capture(wanted, done, force).write.mode("overwrite").json(f"{out}/to_capture")
    panes = spark.createDataFrame([], "url STRING, pos INT, pane_id STRING, heading STRING") if pages is None else C.panes(pages)
    synced = cut(C.resynced(calls, snapshots, panes, scope.canonical), "resynced")
    editions, errors = spark.createDataFrame([], schemas.EDITIONS), spark.createDataFrame([], schemas.ERRORS)
    names = [r["series"] for r in synced.select("series").distinct().orderBy("series").collect()]
    sources.write_report(out, synced, editions, errors, names, None, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    sources.write_calls_csv(f"{out}/csv", synced)


def verify_job(spark: SparkSession, report: str, responses: DataFrame, out: str) -> None:
    """``out``/failures: series and year of calls whose snapshot doesn't play in the stored answers."""
    C.playback_failures(sources.read_calls(spark, report), responses).write.mode("overwrite").json(f"{out}/failures")


def view_job(spark: SparkSession, report: str, summaries: Sequence[str], out: str, *, main: Sequence[str] = (), since: dict[str, int] | None = None) -> None:
    """What the viewer shows: ``out``/cards, tracks, coverage, matrix_data, matrix_doi, chart and papers. Calls are needed, summaries may lack."""
    calls = sources.read_calls(spark, report)
    names = [r["series"] for r in calls.select("series").distinct().orderBy("series").collect()]
    years = [r["year"] for r in calls.select("year").distinct().orderBy("year").collect()]
    loaded = cut(V.loaded_calls(calls, main, [n.upper() for n in names]), "loaded")
    told = (F.col("text"), F.col("series"), F.col("year"), since or {})
    save = lambda df, name: df.write.mode("overwrite").json(f"{out}/{name}")
    save(V.cards(V.find_calls(loaded)), "cards")
    save(V.track_options(loaded), "tracks")
    save(V.coverage(calls), "coverage")
    for name, said in (("data", T.mentions_availability(*told)), ("doi", T.mentions_doi(*told))):
        save(V.matrix(calls, said, names, years), f"matrix_{name}")
    if summaries:
        known = cut(sources.read_summaries(spark, summaries), "summaries")
        save(V.chart(known), "chart")
        listed = known.select("conference", "year", F.inline("papers")).drop("sort_key")
        save(listed, "papers")


def authors_job(spark: SparkSession, authors: str, summary: str, annotations: str, out: str) -> None:
    """The author report: ``out``/authors and ``out``/without_authors. All three files are needed."""
    known = sources.read_authors(spark, authors)
    keys = cut(V.available_keys(sources.read_summaries(spark, [summary]), sources.read_annotations(spark, annotations)), "keys")
    V.author_report(known, keys).write.mode("overwrite").json(f"{out}/authors")
    V.without_authors(known, keys).write.mode("overwrite").json(f"{out}/without_authors")


def fetch_job(spark: SparkSession, urls: DataFrame, fetch: Callable[[str], dict], scope: C.Scope, cache: str, *, robots: DataFrame | None = None) -> DataFrame:
    """Pages of addresses through the caller's ``fetch``; those fetched are added to the cache folder. Returns (url, final_url, html, error)."""
    known = sources.read_table_if_any(spark, cache, "cache_key STRING, html STRING")
    rules, delays = sources.robots_rules(robots) if robots is not None else (None, None)
    got = sources.fetch_pages(urls, fetch, scope, rules=rules, delays=delays, cache=known)
    new = got.filter("html is not null").select(F.col("final_url").alias("url"), "html")
    fresh = new.withColumn("cache_key", F.concat(F.sha2("url", 256), F.lit(".html"))).join(cut(known.select("cache_key"), "known"), "cache_key", "left_anti")
    sources.write_pages_cache(cache, fresh)
    return got


def analyze_job(extracted: DataFrame, ids: Sequence[str] = SECTION_IDS) -> DataFrame:
    """One JSON line per document: statements, identifiers and links."""
    return D.analyze_documents(extracted, ids).select(F.to_json(F.struct("*")).alias("value"))


def read_extracted(spark: SparkSession, path: str) -> DataFrame:
    """Documents with nested lines and link annotations, from JSON lines."""
    return spark.read.schema(schemas.EXTRACTED).json(path)


def read_scope(spark: SparkSession, path: str) -> C.Scope:
    return scope_of(json.loads(spark.read.text(path, wholetext=True).first()["value"]))
