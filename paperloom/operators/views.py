"""What the viewer and the author report show, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paperloom.functions.textnorm import archive_url, safe_url, source_url, track_name

from . import relational as R
from .summary import EVIDENCE, UNSUPPORTED, counts_as_artifact


def loaded_calls(calls: DataFrame, main: Sequence[str], conferences: Sequence[str]) -> DataFrame:
    """Calls with an index, track, search text, source and archive address. ``seq`` is their order."""
    track = F.col("track") if "track" in calls.columns else F.lit(None).cast("string")
    search = F.lower(F.concat_ws(" ", "title", "heading", "text", "edition", "series", "important_dates"))
    return calls.withColumns(
        {
            "important_dates": F.coalesce("important_dates", F.array().cast("array<string>")),
            "track_": track_name(F.col("series"), track, F.col("title"), F.col("heading"), main, conferences),
            "search_": search,
            "source_": source_url(F.col("call_url"), F.col("url")),
            "archive_": archive_url(F.col("snapshot_url"), F.col("call_url"), F.col("url")),
        }
    )


def record_order() -> list[Column]:
    """Newest first, then series, title and the order of the dataset."""
    collated = lambda c: F.collate(F.coalesce(F.col(c), F.lit("")), "UNICODE")
    return [F.coalesce(F.col("year").try_cast("int"), F.lit(0)).desc(), collated("series").asc(), collated("title").asc(), F.col("seq").asc()]


def find_calls(calls: DataFrame, series: Sequence[str] = (), years: Sequence[int] = (), tracks: Sequence[str] = (), search: str = "", page: int | None = None) -> DataFrame:
    """Loaded calls under the chosen facets with all words of ``search``, in record order; one page of 25 if asked."""
    got = R.facet_filter(calls, {"series": series, "year": years, "track_": tracks}, search.split(), F.col("search_"))
    return R.page_of(got, record_order(), page) if page else got.orderBy(*record_order())


def track_options(calls: DataFrame, series: Sequence[str] = (), years: Sequence[int] = ()) -> DataFrame:
    return R.facet_filter(calls, {"series": series, "year": years}, [], F.lit("")).select("track_").distinct().orderBy("track_")


def matrix(calls: DataFrame, mentioned: Column, series: Sequence[str], years: Sequence[int]) -> DataFrame:
    """One row per series, a column per year (newest first): ✓, - or — for no record. First records count."""
    first = calls.withColumn("m_", mentioned).groupBy("series", "year").agg(F.min_by("m_", F.struct("seq")).alias("m_"))
    cell = first.withColumn("cell", F.when(F.col("m_"), "✓").otherwise("-"))
    rows = calls.sparkSession.createDataFrame([(s, i) for i, s in enumerate(series)], "series string, row_ int")
    wide = cell.groupBy("series").pivot("year", sorted(years, reverse=True)).agg(F.first("cell"))
    return rows.join(wide, "series", "left").orderBy("row_").drop("row_").na.fill("—")


def metric_filter(metric: str) -> Column:
    """data: every paper; doi: with a DOI; package: a DOI, an artifact link or a reviewed location."""
    doi, link = F.coalesce(F.size("dois"), F.lit(0)) > 0, F.coalesce(F.size("repository_links"), F.lit(0)) > 0
    return {"data": F.lit(True), "doi": doi, "package": doi | link | counts_as_artifact()}[metric]


def displayed_papers(papers: DataFrame, annotations: DataFrame, metric: str = "data", nonstandard: bool = True) -> DataFrame:
    """Papers that a metric counts with their annotation, and papers that only an annotation names.

    ``papers`` (file, id, sections, dois, repository_links), ``annotations``
    (file, id, annotation, and seq where their order matters); of a file the
    row of least ``seq``, else of least id, counts.
    """
    usable = annotations.filter(F.col("annotation").isNotNull() & ~F.coalesce(F.col("annotation.type") == UNSUPPORTED, F.lit(False)))
    order = "seq" if "seq" in annotations.columns else "id"
    first = usable.groupBy("file").agg(F.min_by(F.struct("annotation", "id"), order).alias("a_"))
    notes = first.select("file", F.col("a_.annotation").alias("annotation"), F.col("a_.id").alias("note_id"))
    own = papers.drop("annotation").join(notes, "file", "left").filter(metric_filter(metric)).drop("note_id")
    if metric == "data" and nonstandard:
        more = notes.join(own.select("file"), "file", "left_anti").select("file", F.col("note_id").alias("id"), "annotation")
        own = own.unionByName(more, allowMissingColumns=True)
    return own.withColumn("sort_key", R.natural_key("id")).orderBy("sort_key").drop("sort_key")


def section_types(papers: DataFrame) -> DataFrame:
    """(summary, nonstandard): section labels by frequency, and how many papers an annotation lists."""
    some = papers.select(F.explode("sections").alias("s")).select(F.lit(0).alias("one_"), F.col("s.label").alias("label"))
    text = R.label_summary(some, ["one_"], "label")
    extra = papers.groupBy(F.lit(0).alias("one_")).agg(F.count_if(F.col("annotation").isNotNull()).alias("nonstandard"))
    return extra.join(text, "one_", "left").select(F.coalesce("summary", F.lit("none")).alias("summary"), "nonstandard")


def chart(summary: DataFrame, conferences: Sequence[str] = (), since: int = 2018) -> DataFrame:
    """(edition, measure, value, step, ceiling) in long form; no conference chosen: all as one."""
    some = summary.filter(F.col("year").rlike(r"^(19|20)[0-9]{2}\z") & (F.col("year").try_cast("int") >= since) & (F.col("checked") > 0))
    some = some.filter(F.col("conference").isin(*conferences)) if conferences else some
    label = F.concat_ws(" ", F.upper("conference"), "year") if conferences else F.col("year")
    sums = some.groupBy(label.alias("edition")).agg(*[F.sum(c).alias(n) for c, n in (("checked", "Accepted"), ("with_statement", "With DAS"), ("with_replication_package", "With Artifact"), ("with_statement_and_doi", "With DOI"))])
    long = sums.unpivot("edition", ["Accepted", "With DAS", "With Artifact", "With DOI"], "measure", "value")
    most = long.groupBy(F.lit(0).alias("one_")).agg(F.max("value").alias("most"))
    step, ceiling = R.nice_axis(F.col("most"))
    one = F.broadcast(most.select("one_", step.alias("step"), ceiling.alias("ceiling")))  # one row
    return long.withColumn("one_", F.lit(0)).join(one, "one_").drop("one_")


def available_keys(summary: DataFrame, annotations: DataFrame) -> DataFrame:
    """Distinct ``year/id`` of papers with a statement, or with reviewed evidence."""
    stated = summary.select("year", F.explode("papers").alias("p")).select(F.concat_ws("/", "year", "p.id").alias("key"))
    noted = annotations.filter(F.col("annotation.type").isin(*EVIDENCE)).select(F.regexp_replace("file", r"(?i)\.pdf\z", "").alias("key"))
    return stated.union(noted).distinct()


def author_report(authors: DataFrame, keys: DataFrame, year: int | None = None, search: str = "", sort: str = "papers", descending: bool = True) -> DataFrame:
    """(name, papers, available) per author. A paper's first row counts, an author once a paper."""
    some = authors if year is None else authors.filter(F.col("year") == year)
    keyed = some.withColumn("key", F.concat_ws("/", F.col("year").cast("string"), "id"))
    order = ["seq"] if "seq" in authors.columns else ["authors"]
    once = keyed.groupBy("key").agg(F.min_by("authors", F.struct(*order)).alias("authors"))
    marked = once.join(keys.distinct().withColumn("ok_", F.lit(True)), "key", "left")
    names = marked.select(F.explode(F.array_distinct("authors")).alias("name"), F.coalesce("ok_", F.lit(False)).alias("ok_"))
    got = names.groupBy("name").agg(F.count(F.lit(1)).alias("papers"), F.count_if("ok_").alias("available"))
    got = got.filter(F.contains(F.lower("name"), F.lit(search.strip().lower())))
    return got.orderBy(F.desc(sort) if descending else F.asc(sort), "name")


def without_authors(authors: DataFrame, keys: DataFrame) -> DataFrame:
    """Available keys that no author table has."""
    return keys.distinct().join(authors.select(F.concat_ws("/", F.col("year").cast("string"), "id").alias("key")), "key", "left_anti")


def cards(calls: DataFrame) -> DataFrame:
    """What a card of each found call shows: series, year, edition, track, heading, preview, dates, and addresses that are safe to follow."""
    safe = lambda c: safe_url(F.col(c)).alias(c.rstrip("_") + "_url")
    return calls.select("series", "year", "edition", F.col("track_").alias("track"), "title", "heading", R.preview("text").alias("preview"), "important_dates", safe("source_"), safe("archive_"))


def drill_down(papers: DataFrame, annotations: DataFrame, conference: str, year: str, metric: str = "data", nonstandard: bool = True) -> DataFrame:
    """The displayed papers (:func:`displayed_papers`) of one conference and year, one row per paper, with address and number of sections."""
    of = lambda df: df.filter((F.col("conference") == conference) & (F.col("year") == year))
    got = displayed_papers(of(papers), of(annotations), metric, nonstandard)
    return got.select("file", "id", F.coalesce(F.size("sections"), F.lit(0)).alias("n_sections"), "dois", "repository_links", "annotation")


def all_summaries(*summaries: DataFrame) -> DataFrame:
    """The summaries of several conferences as one; columns that one lacks are null there."""
    first, *more = summaries
    for s in more:
        first = first.unionByName(s, allowMissingColumns=True)
    return first


def with_totals(df: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of totals over it (``rows`` always), known once any action has run: no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in totals.items()]), seen


def coverage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("series").agg(F.count(F.lit(1)).alias("records"), F.min("year").alias("first"), F.max("year").alias("last"), F.count_if(F.coalesce("snapshot_url", F.lit("")) != "").alias("snapshots"))
