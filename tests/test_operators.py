"""Operators over small tables, and every query against its SQL."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paperloom import schemas, sources, streaming
from paperloom.functions import textnorm as T
from paperloom.operators import crawl as C
from paperloom.operators import documents as D
from paperloom.operators import relational as R
from paperloom.operators import summary as S
from paperloom.operators import views as V

SCOPE = C.Scope("https://meet.example", frozenset(["meet.example", "old.example"]), archives=frozenset(["old.example"]), canonical={"https://meet.example/track/m-2025/research": "https://meet.example/track/m-2025/research#call"})
BODY = "Authors are asked for original work on all that matters here. " * 4


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_text_columns(spark):
    assert one(spark, T.doi_columns, "10.1000/A(b)c)), 10.1000/x;") == T.doi_ids("10.1000/A(b)c)), 10.1000/x;") == ["10.1000/a(b)c", "10.1000/x"]
    assert one(spark, lambda c: T.doi_url(c), "10.1000/a b(c)") == "https://doi.org/10.1000/a%20b(c)"
    assert one(spark, T.heading_column, "D ATA A VAILABILITY") == "DATA AVAILABILITY"
    assert one(spark, T.normalized, "ﬁ­x–y") == "fix-y"
    assert one(spark, T.is_research_title, "M 2025 – Research Track – M") and not one(spark, T.is_research_title, "Posters")
    assert one(spark, T.year_in, "The 2024 edition") == 2024 and one(spark, T.year_in, "12024x") is None
    assert one(spark, T.path_year, "a/2021/x.pdf") == "2021" and one(spark, T.path_year, "a/x.pdf") is None
    assert one(spark, T.paper_id, "2021/doi-10.1000%2Fab.c.pdf") == "ab.c" and one(spark, T.paper_id, "2021/123.4.pdf") == "123.4"
    assert one(spark, lambda p, c: T.paper_url(p, c), "2021/doi-10.1000%2Fab.pdf", "fse") == "https://doi.org/10.1000/ab"
    assert one(spark, lambda p, c: T.paper_url(p, c), "2021/77.pdf", "ase") is None and one(spark, lambda p, c: T.paper_url(p, c), "2021/77.pdf", "fse") == "https://doi.org/10.1145/77"
    assert one(spark, T.safe_url, "HTTP://a/b") and one(spark, T.safe_url, "javascript:x") is None
    assert one(spark, T.archive_url, "https://s/1", "https://a/b#c", "https://a/b") == "https://s/1#c" and one(spark, T.archive_url, "", "x", "x") is None
    assert one(spark, lambda u, b: T.capture_status(u, b), "https://a/b", "see /web/20240101000000/https://a/b here") == "snapshot_reported"
    assert one(spark, lambda u, b: T.capture_status(u, b), "https://a/b", "a captcha") == "needs_review"


def test_mentions(spark):
    since = {"b": 2023}
    df = spark.createDataFrame([("éDOI and data\navailability", "a", 2020), ("datasets must be made and kept available", "b", 2022), ("datasets must be made and kept available", "b", 2023), ("Data", "z", 2023), ("data availability", "n", 2023)], "t string, s string, y int")
    got = df.select(T.mentions_availability(F.col("t"), F.col("s"), F.col("y"), since, ["n"]), T.mentions_doi(F.col("t"), F.col("s"), F.col("y"), since))
    assert rows(got) == [(True, True), (False, False), (True, False), (False, False), (False, False)]


def test_registry(spark):
    body = json.dumps({"data": {"attributes": {"titles": [{"title": "A"}, {"title": "B"}], "creators": [{"name": "N"}], "publisher": "P", "publicationYear": 2020, "rightsList": [], "descriptions": [{"description": "d" * 3000}]}}})
    got = sources.registry_records(spark.createDataFrame([("u", 200, body), ("v", 404, ""), ("w", 500, ""), ("x", 200, "{}")], "url string, status int, body string"))
    flat = got.select("url", T.registry_view(F.col("attributes")).alias("r"), "error").orderBy("url").collect()
    assert (flat[0].r.title, flat[0].r.version, len(flat[0].r.description)) == ("A, B", "not stated", 2000)
    assert [x.error for x in flat] == [None, "no record; another agency may have it", "HTTP 500", "no metadata"]


def test_doi_checks(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("no route")
        return {"status": 200, "url": url + "/x", "redirected": True}

    df = spark.createDataFrame([("d", 0, "ok"), ("d", 1, "bad"), ("d", 30, "late")], "doc_id string, pos int, url string")
    assert rows(sources.check_dois(df, fetch).orderBy("url")) == [("d", "bad", None, False, "bad", False, "no route"), ("d", "ok", 200, True, "ok/x", True, None)]


@pytest.fixture
def pages(spark):
    home = '<title>Home</title><a href="/track/m-2025/research">Research</a><a href="/track/other/x">x</a><a href="/track/m-2025/gone">g</a><a href="/program/m-2025/p">p</a><a href="/info/m-2025/cfp">Call for talks</a>'
    track = f'<title>M 2025 - Research Track</title><div id="content"><div class="tab-pane" id="call"><h2>Call for Papers</h2><p>{BODY}</p></div><div class="tab-pane" id="more"><h2>More</h2><p>We invite you to submit. {BODY}</p></div></div>'
    info = f"<title>Research Papers</title><article><h1>Call for Papers</h1><p>{BODY}</p></article>"
    old = f'<title>Technical Track</title><a href="/track/a">a</a><div class="tab-pane" id="s"><h2>How to submit</h2><p>We invite you to submit. {BODY}</p></div>'
    data = [("https://meet.example/home/m-2025", home), ("https://meet.example/track/m-2025/research", track), ("https://meet.example/info/m-2025/cfp", info), ("https://old.example", old), ("https://old.example/track/a", track)]
    return spark.createDataFrame([("m", "M", 2025, u, h) for u, h in data], schemas.PAGES)


def test_crawl(spark, pages):
    listed = spark.createDataFrame([("m", "M 2025", "/home/m-2025"), ("m", "No year", "/home/x"), ("m", "M 2020", "https://far.example/x"), ("m", "M 2019", "https://old.example/"), ("m", "M 2018", "/people/x")], "series string, edition string, url string")
    starts = C.editions(listed, None, SCOPE)
    assert {(r.year, r.status) for r in starts.collect()} == {(2025, "pending"), (2020, "external_not_crawled"), (2019, "pending"), (2018, "unsupported_url")}
    parsed = C.parse_pages(pages, SCOPE)
    visited = C.crawl(starts, parsed, SCOPE)
    assert {(r.year, r.url.split("example")[1], r.missing) for r in visited.collect()} == {(2025, "/home/m-2025", False), (2025, "/track/m-2025/research", False), (2025, "/track/m-2025/gone", True), (2025, "/info/m-2025/cfp", False), (2019, "", False), (2019, "/track/a", False)}
    snaps = spark.createDataFrame([("https://meet.example/info/m-2025/cfp", "https://s/1")], "url string, snapshot_url string")
    calls = C.call_records(visited, parsed, snaps, SCOPE)
    got = {(r.year, r.call_url, r.snapshot_url, r.heading) for r in calls.collect()}
    assert got == {(2025, "https://meet.example/info/m-2025/cfp", "https://s/1", "Call for Papers"), (2019, "https://old.example#s", "", "How to submit"), (2019, "https://old.example/track/a#call", "", "Call for Papers")}
    report = {r.year: (r.status, r.pages, r.calls) for r in C.edition_report(starts, visited, calls).collect()}
    assert report == {2025: ("crawled", 4, 1), 2020: ("external_not_crawled", None, None), 2019: ("crawled", 2, 2), 2018: ("unsupported_url", None, None)}
    assert C.errors(visited).count() == 1


def test_robots_and_archive(spark):
    urls = spark.createDataFrame([("https://a.example/x/secret/1",), ("https://a.example/open",), ("https://b.example/x/secret",)], "url string")
    rules = spark.createDataFrame([("a.example", "/*/secret")], "host string, pattern string")
    assert rows(C.disallowed(urls, rules)) == [("https://a.example/x/secret/1",)]
    calls = spark.createDataFrame([(0, "s", 2020, "https://a.example/p", None, "Old", "https://web.archive.org/web/1/x"), (1, "s", 2021, "https://a.example/q", "https://a.example/q#z", "H", "")], "seq int, series string, year int, url string, call_url string, heading string, snapshot_url string")
    attempts = spark.createDataFrame([("https://a.example/p", "https://s/p")], "url string, snapshot_url string")
    assert rows(C.to_capture(calls, attempts)) == [("https://a.example/q",)] and C.to_capture(calls, attempts, True).count() == 2
    panes = spark.createDataFrame([("https://a.example/p", 1, "two", "Old"), ("https://a.example/p", 0, "Call-for-x", "n")], "url string, pos int, pane_id string, heading string")
    got = {r.seq: (r.call_url, r.snapshot_url) for r in C.resynced(calls, attempts, panes, {}).collect()}
    assert got == {0: ("https://a.example/p#Call-for-x", "https://s/p"), 1: ("https://a.example/q#z", "")}
    answers = spark.createDataFrame([("https://web.archive.org/web/1/x", 200, "at a.example")], "snapshot_url string, status int, body string")
    assert rows(C.playback_failures(calls, answers)) == [("s", 2021)]


def test_documents(spark):
    items = spark.createDataFrame(
        [("d", 1, 0, "Data", 0.0, 90.0, 20.0, 10.0, 11.0, 0.0, "H", False), ("d", 1, 1, "Availability", 25.0, 91.0, 50.0, 10.0, 11.0, 0.0, "H", True), ("d", 1, 2, "At 10.1000/x", 0.0, 91.0, 60.0, 0.0, 9.0, 0.0, "B", False), ("d", 1, 3, " ", 0.0, 50.0, 1.0, 1.0, 9.0, 0.0, "B", False)],
        schemas.ITEMS,
    )
    lines = D.items_to_lines(items)
    assert [(r.line_no, r.text, len(r.runs), len(r.boxes)) for r in lines.orderBy("line_no").collect()] == [(0, "Data Availability", 3, 2), (1, "At 10.1000/x", 1, 1)]
    links = spark.createDataFrame([("d", "https://github.com/a/b", 1, [0.0, 85.0, 100.0, 100.0]), ("e", "https://x", 1, None)], schemas.LINKS)
    got = {r.doc_id: r for r in D.analyze_documents(D.extracted(lines, links)).collect()}
    assert [x.id for x in got["d"].dois] == ["10.1000/x"] and [x.url for x in got["d"].repository_links] == ["https://github.com/a/b"]
    assert not got["e"].has_text and got["e"].error is None
    excluded = spark.createDataFrame([("d", "data-availability", "Data Availability", 1)], "file string, id string, heading string, page int")
    res = {r.file: (r.status, r.statements, r.dois, len(r.false_positive_sections)) for r in D.file_results(D.analyze_documents(D.extracted(lines, links)), excluded).collect()}
    assert res == {"d": ("checked", 0, 1, 1), "e": ("no_text", 0, 0, 0)}


def results(spark):
    sec = [Row(id="data-availability", label="Data Availability", heading="h", page=1, body="b")]
    kind = "file string, year string, status string, statements int, dois int, pages int, sections array<struct<id:string,label:string,heading:string,page:int,body:string>>, false_positive_sections array<struct<id:string,label:string,heading:string,page:int,body:string>>, doi_ids array<string>, repository_links array<struct<url:string,sources:array<string>>>, error string"
    link = [Row(url="https://github.com/a", sources=["s"])]
    return spark.createDataFrame(
        [("2020/10.pdf", "2020", "checked", 1, 1, 9, sec, [], ["10.1/a"], [], None), ("2020/9.pdf", "2020", "checked", 1, 0, 9, sec, [], [], link, None), ("2020/8.pdf", "2020", "checked", 1, 0, 9, sec, [], [], [], None), ("2020/7.pdf", "2020", "checked", 0, 0, 9, [], sec, [], [], None),
         ("2020/6.pdf", "2020", "checked", 1, 0, 9, sec, [], [], [], None), ("2020/5.pdf", "2020", "no_text", 0, 0, 9, [], [], [], [], None), ("x.pdf", None, "error", 0, 0, None, None, None, None, None, "bad"), ("2020/4.pdf", "2020", "checked", 1, 1, 9, sec, [], ["10.1/b"], [], None)], kind,
    )


def notes(spark):
    a = lambda kind, counts, urls: (kind, counts, None, None, urls, None, None)
    return spark.createDataFrame([("2020/8.pdf", a("artifact-url-outside-allowed-heading", True, ["u"])), ("2020/6.pdf", a("false-positive-das-heading", False, [])), ("2020/7.pdf", a("reviewed-unsupported-heading", False, []))], f"file string, annotation {schemas.ANNOTATION}")


def test_year_summary(spark):
    wrong = spark.createDataFrame([("2020/4.pdf",)], "file string")
    s = {r.year: r for r in S.year_summary(S.reviewed(results(spark), notes(spark), wrong, "fse")).collect()}
    y = s["2020"]
    assert (y.total, y.checked, y.with_statement, y.with_statement_and_doi, y.with_replication_package, y.without_statement, y.no_text, y.errors) == (7, 6, 3, 1, 3, 3, 1, 0)
    assert [p.id for p in y.papers] == ["8", "9", "10"] and [p.id for p in y.false_positives] == ["4", "6", "7"] and [p.id for p in y.annotations] == ["7", "8"]
    assert (s["unknown"].total, s["unknown"].errors) == (1, 1)
    env = json.loads(S.public_envelope(S.year_summary(S.reviewed(results(spark), notes(spark), wrong, "fse")), "fse", "d").first()["value"])
    assert set(env["years"]) == {"2020", "unknown"} and env["years"]["2020"]["checked"] == 6


def test_views(spark):
    wrong = spark.createDataFrame([("2020/4.pdf",)], "file string")
    summary = S.year_summary(S.reviewed(results(spark), notes(spark), wrong, "fse")).cache()
    long = {r.measure: r.value for r in V.chart(summary).collect()}
    assert long == {"Accepted": 6, "With DAS": 3, "With Artifact": 3, "With DOI": 1}
    assert V.chart(summary, ["fse"]).first().edition == "FSE 2020" and V.chart(summary, ["ase"]).count() == 0
    papers = summary.filter("year = '2020'").select(F.explode("papers").alias("p")).select("p.*")
    some = summary.filter("year = '2020'").select(F.explode("annotations").alias("p")).select("p.file", "p.id", "p.annotation")
    names = lambda m, n=True: [r.id for r in V.displayed_papers(papers.drop("annotation"), some, m, n).collect()]
    assert names("data") == ["8", "9", "10"] and names("doi") == ["10"] and names("package") == ["8", "9", "10"]
    assert tuple(V.section_types(V.displayed_papers(papers, some)).first()) == ("Data Availability: 3", 1)
    keys = V.available_keys(summary, notes(spark))
    assert {r.key for r in keys.collect()} == {"2020/8", "2020/9", "2020/10"}
    authors = spark.createDataFrame([(2020, "8", ["Bo", "Al", "Al"], 0), (2020, "8", ["Cy"], 1), (2020, "1", ["Al"], 2)], schemas.AUTHORS + ", seq int")
    assert rows(V.author_report(authors, keys)) == [("Al", 2, 1), ("Bo", 1, 1)] and rows(V.author_report(authors, keys, search="BO")) == [("Bo", 1, 1)]
    assert {r.key for r in V.without_authors(authors, keys).collect()} == {"2020/9", "2020/10"}


def test_calls(spark, tmp_path):
    call = lambda s, y, t, **k: {"series": s, "edition": f"{s} {y}", "year": y, "url": f"https://a/{s}{y}", "call_url": "", "snapshot_url": "", "title": "T", "heading": "H", "text": t, "important_dates": ["d1", "d2"]} | k
    data = [call("x", 2024, "data availability"), call("x", 2024, "later"), call("x", 2023, "none"), call("w", 2024, 'say "DOI",\nplease', title="W 2024 - Posters 2024 - W 2024")]
    (tmp_path / "calls.json").write_text(json.dumps({"calls": data}))
    calls = sources.read_calls(spark, str(tmp_path / "calls.json"))
    view = V.loaded_calls(calls, ["x"], ["W"]).cache()
    assert [(r.series, r.year, r.track_) for r in V.find_calls(view).collect()] == [("w", 2024, "Posters"), ("x", 2024, "Research Track"), ("x", 2024, "Research Track"), ("x", 2023, "Research Track")]
    assert [r.seq for r in V.find_calls(view, series=["x"], search="D1 avail").collect()] == [0] and V.find_calls(view, page=2).count() == 0
    assert rows(V.track_options(view, series=["w"])) == [("Posters",)]
    m = V.matrix(calls, T.mentions_availability(F.col("text"), F.col("series"), F.col("year"), {}), ["w", "x", "v"], [2023, 2024])
    assert m.columns == ["series", "2024", "2023"] and rows(m) == [("w", "-", "—"), ("x", "✓", "-"), ("v", "—", "—")]
    assert {tuple(r) for r in V.coverage(calls).collect()} == {("x", 3, 2023, 2024, 0), ("w", 1, 2024, 2024, 0)}
    sources.write_calls_csv(str(tmp_path / "csv"), calls)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == list(sources.CALL_FIELDS) and back.filter("series = 'w'").first().text == 'say "DOI",\nplease' and back.first().important_dates == "d1\nd2"
    none = spark.createDataFrame([], schemas.EDITIONS), spark.createDataFrame([], schemas.ERRORS)
    sources.write_report(str(tmp_path / "rep"), calls, *none, ["x"], None, "t0")
    assert sources.read_calls(spark, str(tmp_path / "rep/report")).count() == 4 and spark.read.json(str(tmp_path / "rep/calls")).count() == 4
    assert json.loads(next((tmp_path / "rep/report").glob("part-*")).read_text())["errors"] == []
    assert {(r.series, r.preview, r.source_url) for r in V.cards(view.filter("year = 2023")).collect()} == {("x", "none", "https://a/x2023")}
    with pytest.raises(Exception, match="no text"):
        (tmp_path / "bad.json").write_text(json.dumps({"calls": [{"series": "x"}]}))
        sources.read_calls(spark, str(tmp_path / "bad.json")).collect()


def test_files(spark, tmp_path):
    for name, some in (("a-log.json", [{"url": "u", "snapshot_url": "1"}, {"url": "v", "snapshot_url": ""}]), ("b-log.json", [{"url": "u", "snapshot_url": "2"}])):
        (tmp_path / name).write_text(json.dumps(some))
    assert rows(sources.read_snapshots(spark, str(tmp_path / "*-log.json"))) == [("u", "2")]
    (tmp_path / "notes.json").write_text(json.dumps({"2020/1.pdf": {"type": "t", "urls": ["u"]}}))
    assert sources.read_annotations(spark, str(tmp_path / "notes.json")).first().annotation.urls == ["u"]
    assert sources.read_annotations(spark, str(tmp_path / "none.json")).count() == 0 and sources.read_optional(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "authors.json").write_text(json.dumps({"papers": [{"year": 2020, "id": "1", "authors": ["A"]}]}))
    assert sources.read_authors(spark, str(tmp_path / "authors.json")).first().authors == ["A"]
    for p in ("docs/2020/a.PDF", "docs/fm/b.pdf", "docs/2019/c.pdf", "docs/2020/d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    names = lambda **k: {r.file for r in sources.list_documents(spark, str(tmp_path / "docs"), **k).collect()}
    assert names() == {"2020/a.PDF", "fm/b.pdf", "2019/c.pdf"} and names(conference="icse") == {"2020/a.PDF", "2019/c.pdf"} and names(minimum_year=2020) == {"2020/a.PDF"}
    files = sources.list_documents(spark, str(tmp_path / "docs"))
    assert sources.to_extract(files, files.filter("file like '2020%'")).count() == 2
    sources.append_attempts(str(tmp_path / "log"), spark.createDataFrame([("u", "t", "s", "x", "d")], schemas.ATTEMPTS))
    sources.write_json_lines(str(tmp_path / "lines"), spark.range(2))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    cache = spark.createDataFrame([("u", "<p>")], "url string, html string").select(F.concat(F.sha2("url", 256), F.lit(".html")).alias("cache_key"), "html")
    assert {tuple(r)[1:] for r in sources.cached_pages(spark.createDataFrame([("u",), ("v",)], "url string"), cache).select("cache_key", "url", "html").collect()} == {("u", "<p>"), ("v", None)}


def test_clean_urls(spark):
    """As an ordinary URL library resolves, over many forms of links."""
    from urllib.parse import urljoin, urlsplit

    hosts, slash, queries = ["a.example", "b.example"], ["b.example"], [("b.example", "/", "p=calls")]
    bases = ["https://a.example/", "https://a.example", "https://a.example/t/u/v.html?x=1#y", "http://b.example/t/u/"]
    hrefs = [None, "", "#top", "/t/x/#top", "https://c.example/t", "/in?next=1", "mailto:x@a.example", "/u@v", "http://b.example/t/", "https://b.example/?p=calls#x", "https://b.example/?p=no", "//b.example/q/",
             "../up", "./here/", "a/../../b", "..", ".", "a//b", "?q", "x y", "HTTPS://A.Example/Z", "https://a.example:443/p", "javascript:go()", "t;p/..", "../../../../far/", "/a/./b/../c", "https://user@a.example/p", " /pad "]

    def want(href, base):
        u = urlsplit(urljoin(base, href or ""))
        listed = (u.hostname, u.path, u.query) in queries
        if u.scheme not in ("http", "https") or u.hostname not in hosts or "@" in u.path or (u.query and not listed):
            return None
        return f"https://{u.netloc}{u.path if u.hostname in slash else u.path.rstrip('/')}" + (f"?{u.query}" if listed else "")

    df = spark.createDataFrame([(h, b) for h in hrefs for b in bases], "h string, b string")
    got = df.select("h", "b", T.clean_urls(F.col("h"), F.col("b"), hosts, slash, queries).alias("u")).collect()
    assert [(r.h, r.b, r.u) for r in got] == [(r.h, r.b, want((r.h or "").strip(), r.b)) for r in got]


def test_fetch(spark, tmp_path):
    """Redirects, refusals, retries, robots and cache, with a fetcher of its own."""
    from paperloom import jobs

    page = lambda t: f"<title>{t}</title><p>x"

    def fetch(url):
        path = url.split("example", 1)[1]
        if path == "/down":
            raise OSError("no route")
        if path.startswith("/r"):
            n = int(path[2:])
            return {"status": 302, "type": "", "location": f"/r{n + 1}" if n < 20 else "/ok", "body": ""}
        go = {"/go": "ok/", "/self": "/self", "/away": "https://far.example/x", "/loop": "/pool", "/pool": "/loop", "/sly": "/secret/2"}
        if path in go:
            return {"status": 301, "type": "", "location": go[path], "body": ""}
        return {"/busy": {"status": 503, "type": "", "body": ""}, "/gone": {"status": 404, "type": "text/html", "body": ""}, "/pdf": {"status": 200, "type": "application/pdf", "body": ""}, "/soft": {"status": 200, "type": "text/html", "body": page("Page Not Found")}}.get(path, {"status": 200, "type": "text/html; x", "body": page(path)})

    robots = spark.createDataFrame([("meet.example", 200, "User-agent: other\nDisallow: /\n\nUser-Agent: *\nDisallow: /*ecret\nDisallow:\nCrawl-delay: 7\r\n"), ("old.example", 404, "User-agent: *\nDisallow: /")], schemas.ROBOTS)
    rules, delays = sources.robots_rules(robots)
    assert rows(rules) == [("meet.example", "/*ecret")] and rows(delays) == [("meet.example", 7.0)]
    names = ["ok", "go", "self", "away", "loop", "busy", "gone", "pdf", "soft", "down", "secret/1", "sly", "r0", "had"]
    urls = spark.createDataFrame([(f"https://meet.example/{n}",) for n in [*names, "ok"]], "url string")
    cache = spark.createDataFrame([("https://meet.example/had", "<p>old")], "url string, html string")
    sources.write_pages_cache(str(tmp_path / "cache"), cache)
    known = spark.read.parquet(str(tmp_path / "cache"))
    got = {r.url.rsplit("example/", 1)[1]: r for r in sources.fetch_pages(urls, fetch, SCOPE, rules=rules, delays=delays.limit(0), cache=known, sleep=lambda s: None).collect()}
    assert set(got) == set(names)
    assert {k: r.html for k, r in got.items() if r.html} == {"ok": page("/ok"), "go": page("/ok"), "had": "<p>old"} and got["go"].final_url.endswith("/ok")
    assert {k: r.error for k, r in got.items() if r.error} == {
        "self": "external or cyclic redirect: /self", "away": "external or cyclic redirect: https://far.example/x", "loop": "redirect loop or limit exceeded", "busy": "HTTP 503 after retries", "gone": "HTTP 404", "pdf": "not HTML",
        "soft": "page not found", "down": "no route", "secret/1": "robots.txt disallows the address", "sly": "robots.txt disallows the address", "r0": "redirect loop or limit exceeded",
    }
    some = urls.filter("url like '%/had'").unionByName(spark.createDataFrame([("https://old.example/new",)], "url string"))
    for _ in range(2):
        assert jobs.fetch_job(spark, some, fetch, SCOPE, str(tmp_path / "cache")).filter("html is not null").count() == 2
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_series_pages(spark):
    html = '<table><tr class="edition-row x"><td><h3><a href="/home/m-2025">M <b>2025</b></a></h3></td></tr></table><a class="edition-row" href="/home/m-2024"><h3>M 2024</h3></a><div class="edition-row" href="/z"></div>'
    frame = spark.createDataFrame([("m", html), ("n", None)], "series string, html string")
    assert [(r.pos, r.edition, r.url) for r in C.listed_editions(frame).orderBy("pos").collect()] == [(0, "M 2025", "/home/m-2025"), (1, "M 2024", "/home/m-2024"), (2, "/z", "/z")]
    listed = spark.createDataFrame([("m", "M 2025", "https://far.example/m")], "series string, edition string, url string")
    parsed = spark.createDataFrame([("https://meet.example/home/m-2025", "The M2025 meeting"), ("https://meet.example/home/m-2024", "Other")], "url string, title string")
    homes = spark.createDataFrame([("m", 2025, "https://meet.example/home/m-2025"), ("m", 2024, "https://meet.example/home/m-2024")], "series string, year int, url string")
    found = C.verified_homes(homes, parsed)
    assert found.count() == 1 and [(r.status, r.crawl_url) for r in C.editions(listed, None, SCOPE, homes=found).collect()] == [("pending", "https://meet.example/home/m-2025")]
    assert C.editions(listed, None, SCOPE).first().status == "external_not_crawled"


def test_archive_view_and_author_jobs(spark, tmp_path):
    from paperloom.__main__ import main

    call = lambda s, y, **k: {"series": s, "edition": f"{s} {y}", "year": y, "url": f"https://meet.example/{s}{y}", "call_url": f"https://meet.example/{s}{y}", "snapshot_url": "", "title": "T", "heading": "Call for Papers", "text": "We ask for data availability.", "important_dates": []} | k
    (tmp_path / "calls.json").write_text(json.dumps({"calls": [call("m", 2024), call("m", 2023, snapshot_url="https://web.archive.org/web/1/y"), call("w", 2024)]}))
    (tmp_path / "a-log.json").write_text(json.dumps([{"url": "https://meet.example/m2024", "snapshot_url": "https://web.archive.org/web/2/x"}]))
    (tmp_path / "scope.json").write_text(json.dumps({"base": "https://meet.example", "hosts": ["meet.example"]}))
    spark.createDataFrame([("https://meet.example/w2024", '<div class="tab-pane" id="Call-for-x"><h2>n</h2></div>')], "url string, html string").write.parquet(str(tmp_path / "pages"))
    at = lambda *names: [str(tmp_path / n) for n in names]
    main(["archive", *at("calls.json", "*-log.json", "scope.json", "arch"), "--pages", *at("pages")])
    assert [r.url for r in spark.read.json(*at("arch/to_capture")).collect()] == ["https://meet.example/w2024"]
    synced = {(r.series, r.year): (r.call_url.rsplit("/", 1)[1], r.snapshot_url[-3:]) for r in sources.read_calls(spark, *at("arch/report")).collect()}
    assert synced == {("m", 2024): ("m2024", "2/x"), ("m", 2023): ("m2023", "1/y"), ("w", 2024): ("w2024#Call-for-x", "")}
    (tmp_path / "answers.json").write_text("\n".join(json.dumps({"snapshot_url": f"https://web.archive.org/web/{n}", "status": s, "body": "meet.example"}) for n, s in (("2/x", 200), ("1/y", 500))))
    main(["verify", *at("arch/report", "answers.json", "fail")])
    assert {(r.series, r.year) for r in spark.read.json(*at("fail/failures")).collect()} == {("m", 2023), ("w", 2024)}
    paper = {"sort_key": "k", "id": "1", "file": "2024/1.pdf", "url": None, "sections": [{"id": "a", "label": "A", "heading": "h", "page": 1, "body": "b"}], "dois": ["10.1/x"], "repository_links": [], "annotation": None}
    (tmp_path / "fse.json").write_text(json.dumps({"conference": "fse", "generated_at": "t", "detector": "d", "years": {"2024": {"total": 2, "checked": 2, "with_statement": 1, "with_statement_and_doi": 1, "with_replication_package": 1, "without_statement": 1, "no_text": 0, "errors": 0, "papers": [paper], "false_positives": [], "annotations": []}}}))
    main(["view", *at("calls.json", "view"), "--summaries", *at("fse.json", "none.json"), "--main-series", "m", "--since", "w=2025"])
    assert spark.read.json(*at("view/cards")).count() == 3 and {(r.series, r["2024"], r["2023"]) for r in spark.read.json(*at("view/matrix_data")).collect()} == {("m", "✓", "✓"), ("w", "-", "—")}
    assert {(r.measure, r.value) for r in spark.read.json(*at("view/chart")).collect()} == {("Accepted", 2), ("With DAS", 1), ("With DOI", 1), ("With Artifact", 1)} and spark.read.json(*at("view/papers")).count() == 1
    (tmp_path / "authors.json").write_text(json.dumps({"papers": [{"year": 2024, "id": "1", "authors": ["Al", "Bo"]}, {"year": 2024, "id": "2", "authors": ["Al"]}]}))
    (tmp_path / "notes.json").write_text(json.dumps({"2024/3.pdf": {"type": "artifact-url-outside-allowed-heading", "urls": []}}))
    main(["authors", *at("authors.json", "fse.json", "notes.json", "rep")])
    assert {tuple(r) for r in spark.read.json(*at("rep/authors")).select("name", "papers", "available").collect()} == {("Al", 2, 1), ("Bo", 1, 1)}
    assert [r.key for r in spark.read.json(*at("rep/without_authors")).collect()] == ["2024/3"]


def test_totals_summaries_and_caches(spark, tmp_path):
    df, seen = V.with_totals(spark.range(5), "t", odd=F.count_if(F.col("id") % 2 == 1))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 5, "odd": 2}
    a, b = spark.createDataFrame([("x", 1)], "conference string, n int"), spark.createDataFrame([("y", "z")], "conference string, m string")
    assert {tuple(r) for r in V.all_summaries(a, b, a).collect()} == {("x", 1, None), ("y", None, "z")} and V.all_summaries(a, b, a).count() == 3
    files = spark.createDataFrame([("f", "/f", 3, 1), ("g", "/g", 4, 1)], "file string, path string, length long, modificationTime long")
    sources.write_extraction_cache(str(tmp_path / "ex"), files.limit(1), spark.createDataFrame([("f", 9)], "file string, pages int"))
    assert [r.file for r in sources.to_extract(files, spark.read.parquet(str(tmp_path / "ex"))).collect()] == ["g"]


def test_shared_folder_needs_a_setting_on_clusters():
    from types import SimpleNamespace

    from paperloom import storage

    told = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://h:1", getConf=lambda: {}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(told)


def test_stream(spark, tmp_path, pages):
    pages.coalesce(1).write.json(str(tmp_path / "in"))
    for _ in range(2):
        q = streaming.ingest_pages(streaming.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), SCOPE)
        q.awaitTermination()
        pages.limit(2).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == pages.count()


def test_jobs(spark, tmp_path, pages):
    from paperloom import jobs
    from paperloom.__main__ import main

    pages.select("url", "html").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "listed.json").write_text("\n".join(json.dumps({"series": s, "edition": e, "url": u}) for s, e, u in (("m", "M 2025", "/home/m-2025"), ("m", "M 2019", "https://old.example/"), ("w", "W 2025", "/home/w"))))
    scope = {"base": SCOPE.base, "hosts": list(SCOPE.hosts), "archives": list(SCOPE.archives), "keep_slash": list(SCOPE.keep_slash), "queries": [list(q) for q in SCOPE.queries], "call_hosts": list(SCOPE.call_hosts), "research_titles": list(SCOPE.research_titles), "canonical": SCOPE.canonical}
    assert jobs.scope_of(scope) == SCOPE
    (tmp_path / "scope.json").write_text(json.dumps(scope))
    main(["crawl", *[str(tmp_path / x) for x in ("pages", "listed.json", "scope.json", "out")], "--series", "m", "--years", "2025"])
    report = json.loads(next((tmp_path / "out/report").glob("part-*")).read_text())
    assert (report["series"], report["years"], len(report["calls"]), [e["status"] for e in report["editions"]], len(report["errors"])) == (["m"], [2025], 1, ["crawled"], 1)
    lines = [{"line_no": i, "text": t, "page": 1, "boxes": [], "runs": []} for i, t in enumerate(["Data Availability", "At https://github.com/a/b and 10.1000/x"])]
    (tmp_path / "docs.json").write_text(json.dumps({"doc_id": "2020/1.pdf", "pages": 1, "lines": lines, "annotations": []}) + "\n" + json.dumps({"doc_id": "2020/2.pdf", "pages": 1, "lines": [], "annotations": []}))
    main(["batch", str(tmp_path / "docs.json"), "fse", str(tmp_path / "batch")])
    public = json.loads("".join(p.read_text() for p in (tmp_path / "batch/public").glob("part-*")))
    assert public["conference"] == "fse" and {k: public["years"]["2020"][k] for k in ("total", "with_statement", "no_text")} == {"total": 2, "with_statement": 1, "no_text": 1}
    main(["analyze", str(tmp_path / "docs.json"), str(tmp_path / "one"), "--sections", "nothing"])
    assert all(json.loads(r.value)["statements"] == [] for r in spark.read.text(str(tmp_path / "one")).collect())


def test_relational_edges(spark):
    e = spark.createDataFrame([], "k int, o int, v string")
    assert R.first_wins(e, ["k"], ["o"]).count() == 0
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, None)], "k int, o int, v string")
    assert set(rows(R.label_summary(df, ["k"], "v"))) == {(1, "a: 1"), (2, "none")}
    assert one(spark, lambda a: R.expand_range(a.cast("int"), F.lit(3)), "5") == []
    assert one(spark, lambda a: R.natural_key("c0"), "a10b2") < one(spark, lambda a: R.natural_key("c0"), "a10b10")
    tie = spark.createDataFrame([("g", 1, 0), ("g", 2, 5), ("g", 3, 10), ("h", 4, 0)], "g string, k int, t int")
    assert set(rows(R.nearest_other(tie, "g", "k", F.col("t")))) == {(1, 2, 5), (3, 2, 5)}
    words = [("k", "a"), ("k", "ab"), ("k", "abc" * 40), ("k", "abc" * 40 + "d"), ("k", "b"), (None, "b"), (None, "bb"), ("j", "b"), ("k", None), ("k", "ab")]
    frame = spark.createDataFrame(words, "k string, v string")
    assert {tuple(r) for r in R.drop_prefixes(frame, "k", "v").collect()} == {("k", "abc" * 40 + "d"), ("k", "b"), (None, "bb"), ("j", "b")}
    pf = spark.createDataFrame([("g", True, True, 1), ("g", False, True, 2), ("h", False, True, 3), ("h", None, None, 4), (None, False, True, 5)], "g string, p boolean, f boolean, i int")
    assert {r.i for r in R.primary_or_fallback(pf, "g", F.col("p"), F.col("f")).collect()} == {1, 3, 5}
    dom = spark.createDataFrame([(1, "b", 2, 0), (1, "a", 2, 1)], "k int, v string, w int, o int")
    assert rows(R.dominant(dom, "k", "v", "w", "o")) == [(1, "b")]
