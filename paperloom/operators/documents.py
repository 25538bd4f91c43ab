"""Documents: text items to lines, and the analysis of each document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions.detection import SECTION_IDS, analyze

from .rows import map_rows

#: Items whose baselines differ by more are on different lines.
GAP = 3.0


def items_to_lines(items: DataFrame) -> DataFrame:
    """Lines as in :data:`paperloom.schemas.LINES` from positioned text items.

    A line ends where the baseline moves or an item says so; items are joined
    with a space unless one stands there. All within a document's pages.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("item_no")
    new = F.coalesce(F.lag("eol").over(w) | (F.abs(F.col("y") - F.lag("y").over(w)) > GAP), F.lit(False))
    size, tall = F.hypot("scale_x", "scale_y"), F.coalesce(F.nullif(F.abs("height"), F.lit(0.0)), F.lit(10.0))
    box = F.array(F.col("x"), F.col("y") - tall * 0.2, F.col("x") + F.abs("width"), F.col("y") + tall * 0.8)
    part = F.struct("item_no", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("font", F.lit("")).alias("font"), size.alias("size"), box.alias("box"))
    grouped = items.withColumn("new_", new).withColumn("line_", F.sum(F.col("new_").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = grouped.groupBy("doc_id", "page", "line_").agg(F.sort_array(F.collect_list(part)).alias("items_"))
    run = f"array<{schemas.RUN.lower()}>"
    start = F.struct(F.lit("").alias("t"), F.array().cast(run).alias("r"))

    def add(acc, x):
        gap = (acc["t"] != "") & ~acc["t"].rlike(r"\s\z") & ~x["text"].rlike(r"^\s")
        last = F.element_at(acc["r"], -1)
        space = F.when(gap, F.array(F.struct(F.lit(" ").alias("text"), F.length(acc["t"]).alias("start"), last["font"].alias("font"), last["size"].alias("size")))).otherwise(F.array().cast(run))
        text = F.concat(acc["t"], F.when(gap, " ").otherwise(""))
        own = F.array(F.struct(x["text"].alias("text"), F.length(text).alias("start"), x["font"].alias("font"), x["size"].alias("size")))
        return F.struct(F.concat(text, x["text"]).alias("t"), F.concat(acc["r"], space, own).cast(run).alias("r"))

    joined = lines.withColumn("a_", F.aggregate("items_", start, add)).filter(F.trim("a_.t") != "")
    left = F.length("a_.t") - F.length(F.ltrim("a_.t"))
    right = F.length(F.rtrim("a_.t"))
    cut = lambda r: F.substring(r["text"], F.greatest(F.lit(0), left - r["start"]) + 1, F.greatest(F.lit(0), F.greatest(F.lit(0), right - r["start"]) - F.greatest(F.lit(0), left - r["start"])))
    runs = F.filter(F.transform("a_.r", lambda r: r.withField("text", cut(r))), lambda r: r["text"] != "")
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_")) - 1).alias("line_no")
    return joined.select("doc_id", number, F.trim("a_.t").alias("text"), "page", F.transform("items_", lambda x: x["box"]).alias("boxes"), runs.alias("runs"))


def extracted(lines: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One nested row per document from its lines and link annotations."""
    nested = lines.groupBy("doc_id").agg(F.max("page").alias("pages"), F.sort_array(F.collect_list(F.struct("line_no", "text", "page", "boxes", "runs"))).alias("lines"))
    if links is None:
        return nested.withColumn("annotations", F.array().cast(f"array<{schemas.LINK}>"))
    over = links.groupBy("doc_id").agg(F.collect_list(F.struct("url", "page", "rect")).alias("annotations"))
    return nested.join(over, "doc_id", "full")


def analyze_documents(docs: DataFrame, ids: Sequence[str] = SECTION_IDS) -> DataFrame:
    """:data:`paperloom.schemas.ANALYSIS` for nested documents; lines or links that lack a part are that row's ``error``.

    Each document is one row's work, so nothing is shuffled.
    """
    chosen = tuple(ids)

    def run(doc):
        row = {"doc_id": doc["doc_id"], "pages": doc["pages"], "has_text": False, "statements": [], "dois": [], "repository_links": [], "error": None}
        lines, links = doc["lines"] or [], doc["annotations"] or []
        for x in lines:
            x["runs"], x["boxes"] = x.get("runs") or [], x.get("boxes") or []
        if any(x["text"] is None or x["page"] is None for x in lines):
            return row | {"error": "a line has no text or page"}
        if any(x["url"] is None for x in links):
            return row | {"error": "a link has no address"}
        return row | analyze(lines, links, chosen)

    return map_rows(docs.select("doc_id", "pages", "lines", "annotations"), run, schemas.ANALYSIS)


def file_results(analysis: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """One row per file: year, status, counts, sections kept and excluded by review, identifiers, links.

    ``excluded`` lists (file, id, heading, page) of reviewed wrong sections.
    """
    from paperloom.functions.textnorm import path_year

    a = analysis.withColumnRenamed("doc_id", "file")
    section = lambda s: F.struct(s["section_id"].alias("id"), s["section_label"].alias("label"), s["heading"].alias("heading"), s["page"].alias("page"), s["body"].alias("body"))
    a = a.withColumn("all_", F.transform("statements", section))
    if excluded is None:
        a = a.withColumn("out_", F.array().cast("array<struct<id:string,heading:string,page:int>>"))
    else:
        out = excluded.groupBy("file").agg(F.collect_set(F.struct("id", "heading", F.col("page").cast("int").alias("page"))).alias("out_"))
        a = a.join(out, "file", "left").withColumn("out_", F.coalesce("out_", F.array().cast("array<struct<id:string,heading:string,page:int>>")))
    hit = lambda s: F.exists("out_", lambda o: (o["id"] == s["id"]) & (o["heading"] == s["heading"]) & (o["page"] == s["page"]))
    kept, dropped = F.filter("all_", lambda s: ~hit(s)), F.filter("all_", hit)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("has_text"), "checked").otherwise("no_text")
    return a.select("file", path_year(F.col("file")).alias("year"), status.alias("status"), F.size(kept).alias("statements"), F.size("dois").alias("dois"), "pages", kept.alias("sections"), dropped.alias("false_positive_sections"), F.transform("dois", lambda d: d["id"]).alias("doi_ids"), "repository_links", "error")
