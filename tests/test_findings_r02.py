"""Queries on odd rows, and steps that hold for larger tables (findings of round 2)."""

from __future__ import annotations

import hashlib
import json

import __spark_entry__ as entry
from paperloom import schemas, sources
from paperloom.operators import rows


def test_titles_of_odd_references(spark, tmp_path):
    """As in the query's SQL, only ``&amp;`` is a reference."""
    titles = ["A &amp; B &amp", "C &quot;d", "E &am", "F & G", "H &amp;lt; I"]
    spark.createDataFrame([(i, f"https://example.com/{i}", f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = {i: t.replace("&amp;", "&") for i, t in enumerate(titles)}
    assert {r.page_id: r.title for r in entry.queries()["q02_page_titles"](spark, str(tmp_path)).collect()} == want


def test_cache_of_pages_that_share_an_address(spark, tmp_path):
    """Each page has its own html from the cache, whatever others of its address have."""
    spark.createDataFrame([(i, "https://example.com/a", "x" * (i + 1)) for i in range(7)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = entry.queries()["q04_cache_key"](spark, str(tmp_path)).collect()
    assert {r.page_id: r.n for r in got} == {i: i + 1 if i % 3 == 0 else None for i in range(7)}
    assert {r.cache_key for r in got} == {hashlib.sha256(b"https://example.com/a").hexdigest() + ".html"}


def test_mentions_of_the_documents_own(spark, tmp_path):
    """What a document itself says of data or a DOI, also where its head is cut, isn't the rule's mention."""
    heads = {4: "a doi", 10: "data availability", 16: "x " * 197 + "so doit", 11: "dataset is available", 2: "all", 1: None}
    spark.createDataFrame([(i, h, "en", "s", 1) for i, h in heads.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.seq: (r.data, r.doi) for r in entry.queries()["q50_mentions"](spark, str(tmp_path)).collect()}
    assert got == {i: (i == 1, i == 2) for i in heads}
    cells = entry.queries()["q12_availability_matrix"](spark, str(tmp_path)).filter("series = 'en'").first()
    assert (cells.y2022, cells.y2019, cells.y2016) == ("—", "-", "—")


def test_calls_in_csv_keep_blanks(spark, tmp_path):
    calls = spark.createDataFrame([("s", "e", 2020, "u", "", "", "", "h", t, ["d"]) for t in (" a ", "\tb", "\nc\n", ' "d" ', "")], schemas.CALLS)
    sources.write_calls_csv(str(tmp_path / "csv"), calls)
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "csv"))
    assert sorted(r.text or "" for r in back.collect()) == sorted(r.text for r in calls.collect())


def test_ingest_takes_the_least_html_of_an_address(spark, tmp_path):
    """Also where titles have references that the rule doesn't read, which would sort elsewhere."""
    pages = [(i, f"https://example.com/{i % 3}", f"<title>T{'&amp;z &amp' if i < 3 else '&b'} {i}</title>") for i in range(9)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.url: r.title for r in entry.queries()["q71_ingest"](spark, str(tmp_path)).collect()}
    assert got == {f"https://example.com/{i}": f"T&z &amp {i}" for i in range(3)}


def test_rows_from_arrow_columns():
    """As Arrow's own conversion, for slices, nulls and nested values."""
    import pyarrow as pa

    kind = pa.struct([("t", pa.string()), ("b", pa.list_(pa.list_(pa.float64()))), ("n", pa.int32())])
    values = [[{"t": "a", "b": [[1.0, None], []], "n": 1}, None], None, [], [{"t": None, "b": None, "n": None}], [{"t": "é", "b": [None, [2.5]], "n": 3}] * 2]
    a = pa.array(values, pa.list_(kind))
    for first, n in ((0, 5), (1, 3), (4, 1), (2, 0)):
        assert rows.plain(a.slice(first, n)) == a.slice(first, n).to_pylist() == values[first : first + n]


def test_a_worker_has_few_rows_at_once(spark, monkeypatch):
    """A batch is read in parts, also one that ends with lists that are all empty."""
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(spark.range(0).__class__, "mapInArrow", lambda self, run, kind: seen.append(run) or self)
    rows.map_rows(spark.range(1), lambda r: {"n": len(r["a"])}, "n BIGINT")
    batch = pa.RecordBatch.from_pydict({"a": pa.array([[[1]]] * 250 + [[]], pa.list_(pa.list_(pa.int64())))})
    assert [b.num_rows for b in seen[0](iter([batch]))] == [100, 100, 51] and rows.plain(batch["a"].slice(0, 0)) == []


def test_a_page_is_parsed_once(monkeypatch):
    from paperloom.functions import html_calls as H

    page = H.Page.of("<title>T</title><a href='/x'>y</a>")
    monkeypatch.setattr(H.Page, "feed", lambda *_: (_ for _ in ()).throw(ValueError("parsed again")))
    assert (H.title_of(page), H.links_of(page)[0]["href"], H.extract_calls(page)) == ("T", "/x", ([], []))


def test_small_tables_of_long_work_are_spread(spark):
    assert rows.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 4


def test_parts_of_a_join_have_a_bound(spark):
    from paperloom.operators import relational as R

    left, right = spark.range(1000).selectExpr("id % 300 AS k", "id AS v"), spark.range(300).withColumnRenamed("id", "k")
    a, b = R.in_parts(left, right, "k", 20)
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 50 and a.join(b, "k").count() == 1000
    assert R.in_parts(left, right, "k") == (left, right)


def test_reports_and_authors_in_several_documents(spark, tmp_path):
    """No document has more than its share of the rows; positions go on from one to the next."""
    calls = spark.range(25).selectExpr("24 - id AS seq", "'s' AS series", "'e' AS edition", "2020 AS year", "concat('u', 24 - id) AS url", "'' AS call_url", "'' AS snapshot_url", "'' AS title", "'' AS heading", "'t' AS text", "array('d') AS important_dates")
    none = [spark.createDataFrame([], k) for k in (schemas.EDITIONS, schemas.ERRORS)]
    sources.write_report(str(tmp_path / "rep"), calls, *none, ["s"], None, "t0", most=10)
    assert sorted(len(json.loads(f.read_text())["calls"]) for f in (tmp_path / "rep/report").glob("part-*")) == [5, 10, 10]
    assert {r.seq: r.url for r in sources.read_calls(spark, str(tmp_path / "rep/report")).collect()} == {i: f"u{i}" for i in range(25)}
    rows_ = spark.range(7).selectExpr("id * 3 AS seq", "2020 AS year", "string(id) AS id", "array('a') AS authors")
    sources.write_documents(sources.in_documents(rows_, ["seq"], ["year", "id", "authors"], "papers", 3), str(tmp_path / "authors"))
    assert sorted((r.seq, r.id) for r in sources.read_authors(spark, str(tmp_path / "authors")).collect()) == [(i, str(i)) for i in range(7)]
