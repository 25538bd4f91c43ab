"""The crawl over a table of pages: editions, link scope, calls, and what is left to archive."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions.html_calls import Page, editions_of, extract_calls, links_of, panes_of, title_of
from paperloom.functions.textnorm import CALL_PATTERN, clean_urls, is_research_title, year_in
from paperloom.storage import cut

from .relational import first_wins, primary_or_fallback
from .rows import map_rows

FALLBACK_HEADINGS = ("how to submit", "technical track submissions")


@dataclass(frozen=True)
class Scope:
    """What a crawl may visit."""

    base: str
    hosts: frozenset[str]
    archives: frozenset[str] = frozenset()
    keep_slash: frozenset[str] = frozenset()
    queries: frozenset[tuple[str, str, str]] = frozenset()
    call_hosts: frozenset[str] = frozenset()
    research_titles: tuple[str, ...] = ()
    canonical: dict[str, str] = field(default_factory=dict)


def in_reach(href: Column, base: Column, scope: Scope) -> Column:
    """The clean address of a link in a crawl's scope."""
    return clean_urls(href, base, sorted(scope.hosts), sorted(scope.keep_slash), sorted(scope.queries))


def parse_pages(pages: DataFrame, scope: Scope) -> DataFrame:
    """url, title, sections, dates and links (pos, target, text) in scope of every page; one pass, no shuffle."""
    kind = f"url STRING, title STRING, sections ARRAY<{schemas.SECTION}>, dates ARRAY<STRING>, links ARRAY<STRUCT<pos INT, href STRING, text STRING>>"

    def read(r):
        page = Page.of(r["html"])
        sections, dates = extract_calls(page)
        return {"url": r["url"], "title": title_of(page), "sections": sections, "dates": dates, "links": links_of(page)}

    got = map_rows(pages.select("url", "html"), read, kind)
    target = F.transform("links", lambda x: F.struct(x["pos"].alias("pos"), in_reach(x["href"], F.col("url"), scope).alias("target"), x["text"].alias("text")))
    return got.withColumn("links", F.filter(target, lambda x: x["target"].isNotNull()))


def listed_editions(pages: DataFrame) -> DataFrame:
    """(series, pos, edition, url) of the rows of series' index pages (series, html)."""
    kind = "series STRING, editions ARRAY<STRUCT<pos INT, href STRING, label STRING>>"

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(s, editions_of(h)) for s, h in zip(f["series"], f["html"], strict=True)], columns=["series", "editions"])

    rows = pages.select("series", "html").mapInPandas(run, kind).select("series", F.explode("editions").alias("e"))
    return rows.select("series", "e.pos", F.col("e.label").alias("edition"), F.col("e.href").alias("url"))


def panes(pages: DataFrame) -> DataFrame:
    """(url, pos, pane_id, heading) of all panes with an id."""
    kind = "url STRING, panes ARRAY<STRUCT<pos INT, pane_id STRING, heading STRING>>"

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(u, panes_of(h)) for u, h in zip(f["url"], f["html"], strict=True)], columns=["url", "panes"])

    return pages.select("url", "html").mapInPandas(run, kind).select("url", F.inline("panes"))


def path_parts(url: Column) -> Column:
    return F.split(F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), "/")


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def editions(listed: DataFrame, seeds: DataFrame | None, scope: Scope, years: Sequence[int] = (), homes: DataFrame | None = None) -> DataFrame:
    """(series, edition, year, url, crawl_url, status) of listed (series, edition, url) and seeded rows.

    ``homes`` (series, year, url), as from :func:`verified_homes`, take the place of listed addresses.
    """
    rows = listed if seeds is None else listed.unionByName(seeds)
    rows = rows.withColumn("year", year_in(F.col("edition"))).filter(F.col("year").isNotNull())
    rows = rows.filter(F.col("year").isin(list(years))) if years else rows
    rows = rows.withColumn("crawl_url", in_reach(F.col("url"), F.lit(scope.base), scope))
    if homes is not None:
        said = homes.select(F.col("series").alias("s_"), F.col("year").alias("y_"), F.col("url").alias("home_"))
        rows = rows.join(said, (F.col("series") == F.col("s_")) & (F.col("year") == F.col("y_")), "left").withColumn("crawl_url", F.coalesce("home_", "crawl_url")).drop("s_", "y_", "home_")
    parts = path_parts(F.col("crawl_url"))
    root = is_archive_root(F.col("crawl_url"), scope)
    fit = root | ((F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin("home", "track"))
    return rows.withColumn("status", F.when(F.col("crawl_url").isNull(), "external_not_crawled").when(fit, "pending").otherwise("unsupported_url"))


def verified_homes(candidates: DataFrame, parsed: DataFrame) -> DataFrame:
    """Of candidates (series, year, url) those whose page is there and is titled by series and year."""
    met = candidates.join(parsed.select("url", "title"), "url")
    return met.filter(F.regexp(F.col("title"), F.concat(F.lit("(?i)"), F.col("series"), F.lit(r"\s*"), F.col("year").cast("string")))).select("series", "year", "url")


def is_archive_root(url: Column, scope: Scope) -> Column:
    return host_of(url).isin(*scope.archives) & (F.get(path_parts(url), F.lit(0)) == "") if scope.archives else F.lit(False)


def in_scope(home: Column, target: Column, text: Column, year: Column, scope: Scope, series: Column) -> Column:
    """Whether a crawl from ``home`` follows a link."""
    h, t = path_parts(home), path_parts(target)
    tail = F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0)))
    same = F.slice(t, F.lit(2), F.size(tail)) == tail
    root = is_archive_root(home, scope)
    own_archive = (series == "icse") & (host_of(target) == F.concat(year.cast("string"), F.lit(".icse-conferences.org")))
    kind, first = F.concat_ws(" ", text, F.replace(target, F.lit("-"), F.lit(" "))), F.get(t, F.lit(0))
    wanted = first.isin("track", "home") | (first.eqNullSafe("info") & kind.rlike(CALL_PATTERN))
    if scope.call_hosts:
        wanted = wanted | (host_of(target).isin(*scope.call_hosts) & (first == "calls"))
    alone = (F.get(h, F.lit(0)) == "track") & (target != home)
    return ~alone & (~root | (host_of(target) == host_of(home))) & (root | own_archive | same) & wanted


def crawl(starts: DataFrame, parsed: DataFrame, scope: Scope, depth: int | None = None) -> DataFrame:
    """(series, edition, year, url, depth, missing): pages reached from the editions' homes.

    Breadth first over a table of parsed pages; every round joins the new
    addresses with the pages, keeps those not seen before in their edition and
    writes them, so a plan never holds more than one round. It ends when a
    round finds nothing new, or after ``depth`` rounds.
    A page that the table lacks is reported as missing, not followed.
    """
    keys = ["series", "edition", "year"]
    links = cut(parsed.select("url", F.explode("links").alias("link")), "links")
    front = cut(starts.filter("status = 'pending'").select(*keys, F.col("crawl_url").alias("home"), F.col("crawl_url").alias("url")).distinct().withColumn("depth", F.lit(0)), "crawl")
    seen = front
    for d in count(1) if depth is None else range(1, depth + 1):
        step = front.join(links, "url").filter(in_scope(F.col("home"), F.col("link.target"), F.col("link.text"), F.col("year"), scope, F.col("series")))
        step = step.select(*keys, "home", F.col("link.target").alias("url")).distinct()
        front = cut(step.join(seen, [*keys, "url"], "left_anti").withColumn("depth", F.lit(d)), "crawl")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    known = parsed.select("url").distinct().withColumn("known_", F.lit(True))
    return seen.drop("home").join(known, "url", "left").select(*keys, "url", "depth", F.col("known_").isNull().alias("missing"))


def call_records(visited: DataFrame, parsed: DataFrame, snapshots: DataFrame, scope: Scope) -> DataFrame:
    """Calls on visited research pages, first of equal texts per series and year, with addresses joined in.

    Order is that of depth, address and place on the page (``seq``).
    """
    pages = visited.filter("not missing").join(parsed.drop("links"), "url")
    pages = pages.withColumn("title", F.when(F.coalesce("title", F.lit("")) == "", F.col("edition")).otherwise(F.col("title")))
    pages = pages.filter(is_research_title(F.col("title"), scope.research_titles))
    rows = pages.select("*", F.posexplode("sections").alias("pos", "s"))
    rows = rows.withColumn("page_", F.concat_ws("\u0000", "series", "edition", F.col("year").cast("string"), "url"))
    heading = F.coalesce("s.heading", F.lit(""))
    rows = primary_or_fallback(rows, "page_", heading.rlike(CALL_PATTERN), F.lower(heading).isin(*FALLBACK_HEADINGS))
    rows = rows.select("series", "edition", "year", "url", "title", "s.heading", "s.text", "s.anchor", F.col("dates").alias("important_dates"), F.struct("depth", "url", "pos").alias("seq"))
    rows = first_wins(rows, ["series", "year", "text"], ["seq"])
    plain = F.concat("url", F.when(F.coalesce("anchor", F.lit("")) != "", F.concat(F.lit("#"), "anchor")).otherwise(""))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in scope.canonical.items() for x in kv]), F.col("url")) if scope.canonical else F.lit(None)
    joined = rows.join(snapshots.select("url", "snapshot_url"), "url", "left")
    return joined.select("series", "edition", "year", "url", F.coalesce(known, plain).alias("call_url"), F.coalesce("snapshot_url", F.lit("")).alias("snapshot_url"), "title", "heading", "text", "important_dates", "seq")


def edition_report(starts: DataFrame, visited: DataFrame, calls: DataFrame) -> DataFrame:
    """Editions with their final status, pages visited and calls found."""
    keys = ["series", "edition", "year"]
    pages = visited.groupBy(*keys).agg(F.countDistinct("url").alias("pages"))
    found = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"))
    got = starts.join(pages, keys, "left").join(found, keys, "left")
    done = F.col("status") == "pending"
    return got.select(*keys, "url", F.when(done, "crawled").otherwise(F.col("status")).alias("status"), "crawl_url", F.when(done, F.coalesce("pages", F.lit(0))).alias("pages"), F.when(done, F.coalesce("calls", F.lit(0))).alias("calls"))


def errors(visited: DataFrame) -> DataFrame:
    return visited.filter("missing").select("url").distinct().withColumn("error", F.lit("page not available"))


def disallowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Addresses whose path a robots rule (host, pattern with *) forbids."""
    literal = F.regexp_replace("pattern", r"([\\.\[\]{}()+?^$|])", r"\\$1")
    like = rules.select(F.col("host").alias("host_"), F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*"))).alias("like_"))
    # The path keeps its first slash: rules are anchored there.
    path = F.coalesce(F.nullif(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("")), F.lit("/"))
    return urls.join(like, host_of(F.col("url")) == F.col("host_")).filter(F.regexp(path, F.col("like_"))).select(*urls.columns).distinct()


def resynced(calls: DataFrame, snapshots: DataFrame, panes: DataFrame, canonical: dict[str, str]) -> DataFrame:
    """Calls with newer snapshots, and anchors of the first pane (url, pos, pane_id, heading) that fits."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in canonical.items() for x in kv]), F.col("url")) if canonical else F.lit(None)
    rows = calls.withColumn("call_url", F.coalesce(known, F.col("call_url"), F.col("url")))
    fit = rows.filter(~F.contains("call_url", F.lit("#"))).select("url", "heading").distinct().join(panes.withColumnRenamed("heading", "pane_heading"), "url")
    fit = fit.filter((F.col("pane_heading") == F.col("heading")) | F.replace("pane_id", F.lit("-"), F.lit(" ")).rlike(CALL_PATTERN))
    first = fit.groupBy("url", "heading").agg(F.min_by("pane_id", "pos").alias("pane_id"))
    got = rows.join(first, ["url", "heading"], "left").join(snapshots.select("url", F.col("snapshot_url").alias("new_")), "url", "left")
    anchored = F.when(F.col("pane_id").isNotNull() & ~F.contains("call_url", F.lit("#")), F.concat("url", F.lit("#"), "pane_id")).otherwise(F.col("call_url"))
    return got.withColumn("call_url", anchored).withColumn("snapshot_url", F.coalesce("new_", "snapshot_url")).select(*calls.columns)


def to_capture(calls: DataFrame, attempts: DataFrame, force: bool = False) -> DataFrame:
    """Distinct addresses still to be archived."""
    urls = calls.select("url").distinct()
    done = attempts.filter(F.coalesce("snapshot_url", F.lit("")) != "").select("url")
    return urls if force else urls.join(done, "url", "left_anti")


def playback_failures(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """(series, year) of calls whose snapshot doesn't play; from stored answers (snapshot_url, status, body), up to the first refusal."""
    got = calls.join(responses.withColumnRenamed("status", "http_"), "snapshot_url", "left")
    stop = got.groupBy().agg(F.min(F.when(F.col("http_") == 429, F.col("seq"))).alias("stop_"))
    ok = F.col("snapshot_url").startswith("https://web.archive.org/web/") & (F.col("http_") == 200) & F.contains("body", host_of(F.col("url")))
    asked = got.join(F.broadcast(stop), F.col("stop_").isNull() | (F.col("seq") <= F.col("stop_")))  # one row on the right
    return asked.filter(~F.coalesce(ok, F.lit(False))).select("series", "year")
