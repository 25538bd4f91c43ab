"""Readers and writers of the application's files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions.html_calls import title_of
from paperloom.operators.summary import annotation_rows
from paperloom.storage import cut

# The largest document in bytes, least seconds between requests to a host, hops and tries for an address, seconds to wait for a busy server after each try.
MOST_BYTES = 100 * 1024 * 1024
LEAST_DELAY, MOST_HOPS, MOST_TRIES, BACK_OFF = 2.0, 10, 3, 5.0
#: Rows in one JSON document of a file that holds a table.
ROWS_OF_A_DOCUMENT = 10_000
CALL_FIELDS = ("series", "edition", "year", "url", "call_url", "snapshot_url", "title", "heading", "text", "important_dates")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a report (a JSON document, or several that each say at which call they begin), with their position as ``seq``; rows without text are an error."""
    report = spark.read.schema(f"first BIGINT, calls ARRAY<STRUCT<{_fields(schemas.CALLS)}>>").json(path, multiLine=True)
    rows = report.select("first", F.posexplode("calls").alias("seq", "c")).select("c.*", (F.coalesce("first", F.lit(0)) + F.col("seq")).cast("int").alias("seq"))
    return rows.withColumn("text", F.when(F.col("text").isNull(), F.raise_error(F.lit("a call has no text"))).otherwise(F.col("text")))


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in ddl.split(", ")))


def read_snapshots(spark: SparkSession, pattern: str) -> DataFrame:
    """(url, snapshot_url) of attempts that have one; the last file by name, then the last entry, wins."""
    text = spark.read.text(pattern, wholetext=True).select("value", F.input_file_name().alias("file"))
    got = text.select("file", F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{_fields(schemas.ATTEMPTS)}>>")).alias("pos", "a"))
    some = got.filter(F.coalesce("a.snapshot_url", F.lit("")) != "")
    return some.groupBy(F.col("a.url").alias("url")).agg(F.max_by("a.snapshot_url", F.struct("file", "pos")).alias("snapshot_url"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, annotation) from a JSON map; a missing file gives no rows, other failures are raised."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"file STRING, annotation {schemas.ANNOTATION}")
    text = spark.read.text(path, wholetext=True)
    return annotation_rows(text.select(F.from_json("value", f"MAP<STRING, {schemas.ANNOTATION}>", {"mode": "FAILFAST"}).alias("annotations")))


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    """Author rows of a JSON document, or of several as in :func:`in_documents`, with their position as ``seq``."""
    doc = spark.read.schema(f"first BIGINT, papers ARRAY<STRUCT<{_fields(schemas.AUTHORS)}>>").json(path, multiLine=True)
    return doc.select("first", F.posexplode("papers").alias("seq", "p")).select("p.*", (F.coalesce("first", F.lit(0)) + F.col("seq")).cast("int").alias("seq"))


def in_documents(rows: DataFrame, order: Sequence[str], fields: Sequence[str], name: str, most: int = ROWS_OF_A_DOCUMENT) -> DataFrame:
    """(doc_, first, ``name``): all rows in ``order``, in arrays of ``most`` rows; ``first`` is the position of an array's first row.

    Positions are counted in ranges of the order, so no task has all rows.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))  # a row per range
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    at = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1 + F.col("before_")
    placed = dealt.join(F.broadcast(before), "part_").withColumn("at_", at).withColumn("doc_", F.floor(F.col("at_") / most))
    each = F.transform(F.sort_array(F.collect_list(F.struct("at_", *fields))), lambda c: F.struct(*[c[f].alias(f) for f in fields]))
    return placed.groupBy("doc_").agg(each.alias(name)).select("doc_", (F.col("doc_") * most).alias("first"), name)


def write_documents(docs: DataFrame, path: str) -> None:
    """A JSON document a file, in the order of ``doc_``, which isn't written."""
    whole = cut(docs, "documents")
    files = whole.repartitionByRange(max(1, whole.count()), "doc_").drop("doc_")
    files.write.mode("overwrite").option("maxRecordsPerFile", 1).option("ignoreNullFields", False).json(path)


def list_documents(spark: SparkSession, root: str, conference: str = "", minimum_year: int = 0) -> DataFrame:
    """(file, path, length, modificationTime) of the documents below a folder, within the size bound."""
    from paperloom.functions.textnorm import path_year

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.regexp_extract("path", rf".*?/{base}/(.*)\z", 1)
    got = files.select(relative.alias("file"), "path", "length", "modificationTime").filter(F.col("length") <= MOST_BYTES)
    if conference == "icse":
        got = got.filter(F.regexp_extract("file", r"^([^/]*)", 1).rlike(r"^(19|20)[0-9]{2}\z"))
    return got.filter(path_year(F.col("file")).try_cast("int") >= minimum_year) if minimum_year else got


def to_extract(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache doesn't hold with the same path, size and time."""
    return files.join(cache.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")


def cache_key(url: Column) -> Column:
    """The name under which the page cache has an address."""
    return F.concat(F.sha2(url, 256), F.lit(".html"))


def cached_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages with the HTML cached under the digest of their address, if any."""
    return pages.withColumn("cache_key", cache_key(F.col("url"))).join(cache.select("cache_key", "html"), "cache_key", "left")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table that may be absent."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def read_table_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may be absent."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_report(path: str, calls: DataFrame, editions: DataFrame, errors: DataFrame, series: Sequence[str], years: Sequence[int] | None, started_at: str, most: int = ROWS_OF_A_DOCUMENT) -> None:
    """``path``/calls, editions and errors as JSON lines, a row each, and ``path``/report, the same as one JSON document.

    Of more than ``most`` calls the report is several documents, each of which
    says at which call it begins; editions and errors are in the first.
    """
    order = ["seq", *CALL_FIELDS] if "seq" in calls.columns else list(CALL_FIELDS)
    doc = calls.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("doc_"))
    for name, (frame, columns) in {"calls": (calls.select(*order), order), "editions": (editions, editions.columns), "errors": (errors, errors.columns)}.items():
        frame.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
        if name == "calls":
            row = in_documents(frame, order, CALL_FIELDS, name, most)
        else:
            row = frame.groupBy(F.lit(0).cast("bigint").alias("doc_")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        doc = doc.join(row, "doc_", "full").withColumn(name, F.coalesce(name, F.array().cast(row.schema[name].dataType)))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    wanted = F.lit(None).cast("array<int>") if years is None else F.array(*[F.lit(y) for y in years]).cast("array<int>")
    write_documents(doc.select("doc_", F.lit(started_at).alias("started_at"), now.alias("updated_at"), F.array(*[F.lit(s) for s in series]).alias("series"), wanted.alias("years"), "editions", F.coalesce("first", F.lit(0)).alias("first"), "calls", "errors"), f"{path}/report")


def write_calls_csv(path: str, calls: DataFrame) -> None:
    """Ten columns with a header; date rows are joined by line breaks, quotes doubled, blanks around a value kept."""
    flat = calls.withColumn("important_dates", F.array_join("important_dates", "\n")).select(*CALL_FIELDS)
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    flat.write.mode("overwrite").options(header=True, quoteAll=False, escape='"', **whole).csv(path)


def append_attempts(path: str, attempts: DataFrame) -> None:
    attempts.write.mode("append").json(path)


def write_json_lines(path: str, frame: DataFrame) -> None:
    frame.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_pages_cache(path: str, pages: DataFrame) -> None:
    """Append fetched pages (url, html) to the page cache, under the digest of their address."""
    fetched = pages.filter(F.col("html").isNotNull())
    fetched.select(cache_key(F.col("url")).alias("cache_key"), "html").dropDuplicates(["cache_key"]).write.mode("append").parquet(path)


def write_extraction_cache(path: str, files: DataFrame, extracted: DataFrame) -> None:
    """Append extracted documents (file and any columns) with the path, length and modificationTime of their file, by which :func:`to_extract` knows them."""
    files.select("file", "path", "length", "modificationTime").join(extracted, "file").write.mode("append").parquet(path)


def read_summaries(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(conference, year, summary) of public documents, as one table; a missing document gives no rows."""
    kind = f"conference STRING, generated_at STRING, detector STRING, years MAP<STRING, {schemas.YEAR}>"
    some = [read_optional(spark, p, kind) for p in paths]
    whole = some[0]
    for s in some[1:]:
        whole = whole.unionByName(s)
    return whole.select("conference", F.explode("years").alias("year", "s")).select("conference", "year", "s.*")


def robots_rules(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, pattern), (host, delay)) for all agents, from stored robots.txt answers (host, status, body); none where there is no file."""
    lines = answers.filter(F.col("status") == 200).select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line"))
    key, value = F.lower(F.substring_index("line", ":", 1)), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)\z", 1))
    told = lines.select("host", "pos", key.alias("key"), value.alias("value"))
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("host").orderBy("pos"))
    ours = told.withColumn("agent", agent).filter("agent = '*'")
    rules = ours.filter("key = 'disallow' and value <> ''").select("host", F.col("value").alias("pattern")).distinct()
    delays = ours.filter("key = 'crawl-delay'").groupBy("host").agg(F.greatest(F.lit(LEAST_DELAY), F.max_by(F.col("value").try_cast("double"), "pos")).alias("delay"))
    return rules, delays


def fetch_pages(urls: DataFrame, fetch: Callable[[str], dict], scope, *, rules: DataFrame | None = None, delays: DataFrame | None = None, cache: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, final_url, html, error): one row per distinct address of ``urls`` (url).

    ``fetch(url)`` returns status, type, location and body; it is the
    caller's, so nothing here reaches a network. Redirects are followed a hop
    a round, all addresses together: at most MOST_HOPS pages are asked for one
    address, none twice, and every target has to be in the crawl's scope.
    Cached pages are taken from ``cache`` (cache_key, html); addresses that a
    rule (host, pattern) forbids aren't asked. Of one host one task asks, with
    its delay (host, delay) between two requests; a busy server is asked
    MOST_TRIES times. Each round is written, so a lost task asks again for its
    own addresses only.
    """
    from paperloom.operators.crawl import disallowed, host_of, in_reach

    kind = "url STRING, at STRING, hops ARRAY<STRING>, status INT, html STRING, location STRING, error STRING"

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for f in frames:
            out = []
            for url, at, hops, host, delay in zip(f["url"], f["at"], f["hops"], f["host"], f["delay"], strict=True):
                row = {"url": url, "at": at, "hops": list(hops), "status": None, "html": None, "location": None, "error": None}
                for tried in range(MOST_TRIES):
                    if host in last:
                        sleep(max(0.0, delay - (time.monotonic() - last[host])))
                    last[host] = time.monotonic()
                    try:
                        r = fetch(at)
                    except Exception as e:  # noqa: BLE001  (whatever the caller's function raises)
                        row["error"] = str(e) or type(e).__name__
                        break
                    row["status"] = status = r["status"]
                    if status == 429 or status >= 500:
                        sleep(BACK_OFF * (tried + 1))
                        row["error"] = f"HTTP {status} after retries"
                        continue
                    row["error"] = None
                    if 300 <= status < 400 and r.get("location"):
                        row["location"] = r["location"]
                    elif status >= 400:
                        row["error"] = f"HTTP {status}"
                    elif "html" not in (r.get("type") or ""):
                        row["error"] = "not HTML"
                    elif "not found" in title_of(r["body"]).lower():
                        row["error"] = "page not found"
                    else:
                        row["html"] = r["body"]
                    break
                out.append(row)
            got = pd.DataFrame(out, columns=["url", "at", "hops", "status", "html", "location", "error"])
            got["status"] = got["status"].astype("Int32")
            yield got

    final = ["url", "final_url", "html", "error"]
    todo = urls.select("url").distinct().select("url", F.col("url").alias("at"), F.array("url").alias("hops"))
    done: list[DataFrame] = []
    for _ in range(MOST_HOPS):
        if rules is not None:
            no = cut(disallowed(todo.select("at").distinct().withColumnRenamed("at", "url"), rules).select(F.col("url").alias("at")), "forbidden")
            done.append(todo.join(no, "at", "left_semi").select("url", F.col("at").alias("final_url"), F.lit(None).cast("string").alias("html"), F.lit("robots.txt disallows the address").alias("error")))
            todo = todo.join(no, "at", "left_anti")
        if cache is not None:
            had = cached_pages(todo.withColumnsRenamed({"url": "first_", "at": "url"}), cache).withColumnsRenamed({"url": "at", "first_": "url"})
            had = cut(had.select("url", "at", "hops", "html"), "cached")
            done.append(had.filter("html is not null").select("url", F.col("at").alias("final_url"), "html", F.lit(None).cast("string").alias("error")))
            todo = had.filter("html is null").drop("html")
        hosted = todo.withColumn("host", host_of(F.col("at")))
        paced = hosted.join(delays, "host", "left") if delays is not None else hosted.withColumn("delay", F.lit(None).cast("double"))
        dealt = paced.select("url", "at", "hops", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("delay", F.lit(LEAST_DELAY)).alias("delay")).repartition("host").sortWithinPartitions("host", "at")
        got = cut(dealt.mapInPandas(ask, kind), "fetched")
        target = got.filter("location is not null").withColumn("to", in_reach(F.col("location"), F.col("at"), scope))
        fault = F.when(F.col("to").isNull() | (F.col("to") == F.col("at")), F.concat(F.lit("external or cyclic redirect: "), F.col("location"))).when(F.array_contains("hops", F.col("to")) | (F.size("hops") >= MOST_HOPS), "redirect loop or limit exceeded")
        done.append(got.filter("location is null").select("url", F.col("at").alias("final_url"), "html", "error"))
        done.append(target.withColumn("error", fault).filter("error is not null").select("url", F.col("at").alias("final_url"), "html", "error"))
        todo = target.filter(fault.isNull()).select("url", F.col("to").alias("at"), F.concat("hops", F.array("to")).alias("hops"))
        if todo.isEmpty():
            break
    whole = done[0].select(*final)
    for d in done[1:]:
        whole = whole.unionByName(d.select(*final))
    return cut(whole, "pages")


def check_dois(dois: DataFrame, fetch: Callable[[str], dict], most: int = 30) -> DataFrame:
    """HTTP state of the first ``most`` identifiers of each document (doc_id, pos, url).

    ``fetch(url)`` returns status, url and redirected; it is the caller's, so
    nothing here reaches a network. A failure is that row's error.
    """
    some = dois.filter(F.col("pos") < most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for url in f["url"]:
                try:
                    r = fetch(url)
                    out.append((url, r["status"], 200 <= r["status"] < 300, r.get("url") or url, bool(r.get("redirected")), None))
                except Exception as e:  # noqa: BLE001  (whatever the caller's function raises)
                    out.append((url, None, False, url, False, str(e) or type(e).__name__))
            got = pd.DataFrame(out, columns=["url", "status", "ok", "final_url", "redirected", "error"])
            got["status"] = got["status"].astype("Int32")
            yield pd.concat([f[["doc_id"]].reset_index(drop=True), got], axis=1)

    return some.select("doc_id", "url").mapInPandas(run, f"doc_id {dois.schema['doc_id'].dataType.simpleString()}, {schemas.DOI_CHECK}")


def registry_records(responses: DataFrame) -> DataFrame:
    """(url, attributes, error) from stored answers (url, status, body) of a DOI registry."""
    data = F.from_json("body", f"STRUCT<data: STRUCT<attributes: {schemas.REGISTRY}>>")["data"]["attributes"]
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    error = F.when(F.col("status") == 404, "no record; another agency may have it").when(~ok, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(data.isNull(), "no metadata")
    return responses.select("url", F.when(ok, data).alias("attributes"), error.alias("error"))
