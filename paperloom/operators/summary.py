"""Reviews joined in, and summaries per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.textnorm import paper_id, paper_url

from .relational import natural_key

WRONG, UNSUPPORTED = "false-positive-das-heading", "reviewed-unsupported-heading"
#: Types of annotations that show availability outside an allowed heading.
EVIDENCE = ("artifact-evidence-under-unsupported-heading", "artifact-url-outside-allowed-heading", "artifact-url-under-unsupported-heading")


def annotation_rows(frame: DataFrame, column: str = "annotations") -> DataFrame:
    """(file, annotation) from a map keyed by file."""
    return frame.select(F.explode(column).alias("file", "annotation"))


def reviewed(results: DataFrame, annotations: DataFrame, wrong_files: DataFrame, conference: str) -> DataFrame:
    """File results with their annotation, review mark, paper id and address."""
    marks = wrong_files.select("file").distinct().withColumn("listed_", F.lit(True))
    got = results.join(annotations.select("file", "annotation"), "file", "left").join(marks, "file", "left")
    mark = F.coalesce("listed_", F.lit(False)) | F.coalesce(F.col("annotation.type") == WRONG, F.lit(False))
    name = F.lit(conference)
    return got.select("*", mark.alias("wrong"), name.alias("conference"), paper_id(F.col("file")).alias("id"), paper_url(F.col("file"), name).alias("url")).drop("listed_")


def counts_as_artifact(annotation: str = "annotation") -> Column:
    a = F.col(annotation)
    return F.coalesce(a["count_as_artifact"], F.lit(False)) & (F.coalesce(F.size(a["urls"]), F.lit(0)) > 0)


def summary_rows(rows: DataFrame) -> DataFrame:
    """One row per paper and list that it is on (papers, false_positives, annotations): conference, year, list, and the paper's fields.

    This is the summary's detail at any size; :func:`year_summary` has it as lists.
    """
    checked, stated = F.col("status") == "checked", F.coalesce(F.col("statements"), F.lit(0)) > 0
    paper = F.struct(natural_key("id").alias("sort_key"), "id", "file", "url", "sections", F.col("doi_ids").alias("dois"), "repository_links", "annotation")
    fewer = paper.withField("sections", F.col("false_positive_sections")).withField("dois", F.array().cast("array<string>"))
    on = lambda name, when, what: F.when(when, F.struct(F.lit(name).alias("list"), what.alias("paper")))
    noted = F.col("annotation").isNotNull() & ~F.coalesce(F.col("annotation.type") == WRONG, F.lit(False))
    lists = F.array(
        on("papers", checked & stated & ~F.col("wrong"), paper), on("false_positives", checked & (F.coalesce(F.size("false_positive_sections"), F.lit(0)) > 0), fewer),
        on("false_positives", checked & stated & F.col("wrong"), paper), on("annotations", checked & noted, paper),
    )
    each = rows.select("conference", F.coalesce("year", F.lit("unknown")).alias("year"), F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("x"))
    return each.select("conference", "year", "x.list", "x.paper.*")


def year_counts(rows: DataFrame) -> DataFrame:
    """Eight counts per conference and year; no year is ``unknown``. Combined before the shuffle."""
    checked, stated = F.col("status") == "checked", F.coalesce(F.col("statements"), F.lit(0)) > 0
    good, dois, links = checked & stated & ~F.col("wrong"), F.coalesce(F.col("dois"), F.lit(0)) > 0, F.coalesce(F.size("repository_links"), F.lit(0)) > 0
    known = F.coalesce(F.col("status").isin("checked", "no_text"), F.lit(False))
    count = {
        "total": F.lit(True), "checked": checked, "with_statement": good, "with_statement_and_doi": good & dois, "with_replication_package": good & (dois | links | counts_as_artifact()),
        "without_statement": checked & ~good, "no_text": F.col("status") == "no_text", "errors": ~known,
    }
    return rows.groupBy("conference", F.coalesce("year", F.lit("unknown")).alias("year")).agg(*[F.count_if(c).alias(n) for n, c in count.items()])


def year_summary(rows: DataFrame) -> DataFrame:
    """:func:`year_counts` with the lists of :func:`summary_rows`, in natural order of the papers' ids: one row per conference and year by its form."""
    detail = summary_rows(rows)
    fields = [c for c in detail.columns if c not in ("conference", "year", "list")]
    of = lambda name: F.sort_array(F.collect_list(F.when(F.col("list") == name, F.struct(*fields)))).alias(name)
    lists = detail.groupBy("conference", "year").agg(of("papers"), of("false_positives"), of("annotations"))
    got = year_counts(rows).join(lists, ["conference", "year"], "left")
    return got.withColumns({n: F.coalesce(n, F.array().cast(got.schema[n].dataType)) for n in ("papers", "false_positives", "annotations")})


def public_envelope(summary: DataFrame, conference: str, detector: str) -> DataFrame:
    """One JSON document: metadata and the years as a map."""
    years = F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", F.struct(*[c for c in summary.columns if c not in ("conference", "year")])))))
    return summary.filter(F.col("conference") == conference).agg(F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"), F.lit(conference).alias("conference"), F.lit(detector).alias("detector"), years.alias("years"))).alias("value"))
