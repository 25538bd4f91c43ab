"""Secrets, BPE, HTML, rules, packing: exact against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, html_content, packing, quality_rules, secret_scan

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
ALPHABET = "ab Cd'st'll  \n\n\t.,!?<|endoftext|>éñ日本語  \u0085\x1c\x1d0123४²½😀‍́XİΣςßǅ"


def noise(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, 60))) for _ in range(n)] + ["", "<|endoftext|>", "a<|endoftext|>b  c", "don't  'tis", "x  \n y"]


def test_bpe_is_the_librarys():
    own, library = bpe.ForcedBoundaryBPE(public.path("byte_bpe_50k.json")), tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for t in noise(1500):
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ",".join(map(str, ids))
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_tables(spark, odd):
    path = public.path("byte_bpe_50k.json")
    got = bpe.round_trip(odd, path).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}
    for r, d in zip(sorted(got, key=str), sorted(odd.select("doc_id", "text").collect(), key=lambda d: str(d.doc_id)), strict=False):
        if d.doc_id == r.doc_id and d.doc_id is not None:
            assert r.decoded_sha256 in {hashlib.sha256((x.text or "").encode()).hexdigest() for x in odd.filter(f"doc_id = {d.doc_id}").collect()}
    back = bpe.decode(bpe.encode(odd.filter("doc_id is not null"), path), path)
    assert sorted(map(tuple, back.collect())) == sorted((r.doc_id, r.text or "") for r in odd.filter("doc_id is not null").collect())
    assert bpe.round_trip(odd.limit(0), path).count() == 0


def test_word_ids_are_the_librarys():
    own, library = packing.WordIds(public.path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for t in noise(1500, 1):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing(spark, odd):
    path = public.path("word_bpe_49k.json")
    got = packing.pack(odd, path, capacity=64).collect()
    library = tokenizers.Tokenizer.from_file(path)
    want = []
    for d in odd.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [0]
        want += [(d.doc_id, i, i * 64, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, p in enumerate(ids[k : k + 64] for k in range(0, len(ids), 64))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) <= 64
    assert packing.pack(odd.limit(0), path).count() == 0


def test_plan_is_close_to_the_bound():
    r = random.Random(3)
    for scale in (1, 7):
        counts = {n: r.randint(0, 9) * scale for n in range(1, 129)}
        groups = packing.plan(counts, 128)
        used = {}
        for n, items in groups:
            assert sum(items) <= 128
            for p in items:
                used[p] = used.get(p, 0) + n
        assert used == {k: v for k, v in counts.items() if v}
        bound = max(-(-sum(k * v for k, v in counts.items()) // 128), sum(v for k, v in counts.items() if k > 64))
        assert sum(n for n, _ in groups) <= bound * 1.03 + 1
    assert packing.plan({}) == [] and packing.plan({2048: 3}) == [(3, [2048])]


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets_base_and_added():
    r = random.Random(5)
    s = secret_scan.Scanner()
    parts = ["Token = '", "API_KEY:", "apikey=", "secret=secret=", "AKIA", "password\": \"", "0123456789abcdef", "QWERTY12345678", "a.b-c_d/e+f=g", " ", "\n", "é", "ſecret=", "pasſword=123456789012"]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=r.randint(1, 8)))
        base, every = s.scan(t)
        assert base == brute_secrets(t) and set(base) <= set(every)
    key = "".join(random.Random(1).choices(secret_scan.ALPHABET[:62], k=40))
    assert [k for _, k, _ in s.scan(f"we use {key} here")[1]] == [3]
    assert s.scan("an internationalisationcommitteemeeting and get_user_identifier_from_request here")[1] == []


def test_markov_held_out():
    s = secret_scan.Scanner()
    some = [(x, y) for x, y in secret_scan.labelled_sample(400, seed=99) if len(x) >= 20]
    right = sum((s.model.score(x) >= max(s.least, s.per_char * len(x))) == y for x, y in some)
    assert right / len(some) > 0.97


def test_markov_other_sources():
    """Secrets and names that have nothing to do with the training sample: digests of counters, and this interpreter's own names."""
    import base64
    import hashlib
    import sys

    s = secret_scan.Scanner()
    found = lambda x: any(k == 3 and a <= 4 and b >= 4 + len(x) for a, k, b in s.scan(f"see {x} now")[1])
    digests = [hashlib.sha512(str(i).encode()).digest() for i in range(400)]
    keys = [x for i, d in enumerate(digests) for x in (base64.b64encode(d).decode()[: 20 + i % 40].rstrip("="), base64.urlsafe_b64encode(d).decode()[:43], base64.b32encode(d).decode()[:32])]
    hits = sum(map(found, keys))
    names = sorted({n for m in list(sys.modules.values()) if m and (m.__name__.startswith(("pyspark", "pandas", "email", "xml"))) for n in dir(m) if len(n) >= secret_scan.LEAST and n.isascii()})
    wrong = sum(map(found, names))
    assert hits >= 0.97 * len(keys)
    assert len(names) > 300 and wrong <= 0.01 * len(names)
    assert hits / (hits + wrong) > 0.98
    assert s.scan(f"curl https://host.example/v1/files/{keys[1]}/data")[1] and not s.scan("/" * 60 + " " + "=" * 40 + " " + "-" * 30)[1]


def test_markov_inside_paths_and_identifiers():
    """Keys behind, before and between ordinary parts are found whole, and the ordinary parts alone aren't."""
    r = random.Random(21)
    s = secret_scan.Scanner()
    around = [("files/", ""), ("var/lib/config/", ""), ("home/user/projects/settings/production/", ""), ("get_user_identifier_from_request_", ""), ("internal-service-account-", "-settings"), ("home/user/projects/", "/settings/production"), ("cache/deadbeefdeadbeef01/settings/", "")]
    for before, behind in around:
        assert [k for _, k, _ in s.scan(f"see {before}settings{behind} here")[1] if k == 3] == []
        for n in (24, 32, 40):
            whole = 0
            for _ in range(100):
                key = "".join(r.choices(secret_scan.ALPHABET[:62], k=n))
                text = f"see {before}{key}{behind} here"
                at = text.index(key)
                base, every = s.scan(text)
                assert base == brute_secrets(text)
                whole += any(k == 3 and a <= at and at + n <= b for a, k, b in every)
            assert whole >= 95
    keys = ["".join(r.choices(secret_scan.ALPHABET[:62], k=40)) for _ in range(2)]
    text = keys[0] + "/home/user/projects/settings/production/international/committee/identifier/request/" + keys[1]
    got = s.scan(text)[1]
    assert all(any(a <= text.index(k) and text.index(k) + 40 <= b for a, _, b in got) for k in keys) and not any(a <= text.index("committee") < b for a, _, b in got)


def test_maximal_segments():
    """As the definition: the best segment, then the same on either side of it."""

    def brute(x, a, b):
        best = max(((sum(x[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*brute(x, a, i), (i, j), *brute(x, j, b)]

    r = random.Random(4)
    for _ in range(300):
        x = [float(r.randint(-9, 8)) + r.randint(0, 999) / 1024 for _ in range(r.randint(0, 25))]
        assert secret_scan.maximal(x) == brute(x, 0, len(x))


def test_secret_tables(odd, make):
    got = secret_scan.find(odd).collect()
    assert len(got) == odd.count() and all(r.spans == [] for r in got)
    assert secret_scan.find(odd.limit(0)).count() == 0
    d = make(["my token=abcdefghijkl1 and AKIAABCDEFGHIJKLMN.", None, ""])
    r = secret_scan.redact(d)
    assert r.columns == d.columns and [x.text for x in r.orderBy("doc_id").collect()] == ["my [secret] and [secret].", None, ""]


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules(odd, make):
    r = random.Random(2)
    texts = ["".join(r.choices(["a", "b ", "\n", "# ", "é", " ", "\t"], k=r.randint(0, 80))) for _ in range(150)] + [None]
    for df in (odd, make(texts)):
        got = quality_rules.judge(df)
        want = [brute_counts(d.text or "") for d in df.collect()]
        assert sorted(want) == sorted((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got.collect())
        for x in got.collect():
            assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and not (x.base_failed and x.kept)
    good = " ".join(f"the word{i}" for i in range(40))
    d = make([good, good.upper().replace(" ", "!! "), good.replace(" ", "### "), "short", None])
    kept = quality_rules.keep_good(d)
    assert kept.columns == d.columns and [x.doc_id for x in kept.collect()] == [0]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality_rules.keep_good(d, ()).count() == 3 and quality_rules.judge(d.limit(0)).count() == 0


def test_stop_words_bind_listed_languages(spark):
    """A clean text in a language without a list stays; a listed or untold language is held to its list."""
    none = " ".join(f"sana{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    langs = ["fi", "en", "EN-gb", "de_AT", "", None, "fi-FI", "ru"]
    d = spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string").withColumn("text", F.lit(none))
    assert {r.doc_id for r in quality_rules.keep_good(d).collect()} == {0, 6, 7}
    assert {r.doc_id: r.failed_rules for r in quality_rules.judge(d).collect()} == {i: "" if i in (0, 6, 7) else "stop_words" for i in range(8)}
    assert quality_rules.keep_good(d.drop("lang")).count() == 0 and quality_rules.keep_good(d, lang=None).count() == 0
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    names = quality_rules.judge(d).columns
    want = con.sql(f"SELECT doc_id, kept, failed_rules FROM ({quality_rules.SQL}) ORDER BY doc_id").fetchall()
    assert names[0] == "doc_id" and want == [tuple(r) for r in quality_rules.judge(d).orderBy("doc_id").select("doc_id", "kept", "failed_rules").collect()]


def test_min_cut_against_all_labellings():
    r = random.Random(0)
    for _ in range(600):
        n = r.randint(1, 8)
        s = [round(r.uniform(-3, 3), 3) for _ in range(n)]
        e = [(r.randrange(n), r.randrange(n), round(r.uniform(0, 2), 1)) for _ in range(r.randint(0, 14))]
        cost = lambda c: sum(max(x, 0) if not y else max(-x, 0) for x, y in zip(s, c, strict=True)) + sum(w for a, b, w in e if c[a] != c[b])  # noqa: B023, E731
        assert abs(cost(html_content.min_cut(s, e)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6


P = "<p>Some words that make up a long enough sentence for the article to go on.</p>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<script>x</script>", ""),
        ("<body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><main><h1>Title &amp; more</h1><p>First   <b>bold</b>\ntext of the main part of this page.<br>Line.</p><p>Short.</p></main><footer>End</footer></body>", "Title & more\n\nFirst bold text of the main part of this page. Line.\n\nShort."),
        (f"<article><h1>T</h1>{P}<aside>See also these many other things that we have written.</aside><div class='comments'>{P}</div><form><label>Your name</label><input></form></article>", "T\n\n" + re.sub("<.*?>", "", P)),
        (f"<div class='sidebar'>{P}</div><div id='content'><h2>T</h2>{P}</div><div class='cookie-notice'>{P}</div><div class='ad'>{P}</div>", "T\n\n" + re.sub("<.*?>", "", P)),
        (f"<article>{P}<style>p{{}}</style><!-- c --><script>var t='</p>';</script><p hidden>{P[3:]}</article>", re.sub("<.*?>", "", P)),
        ("<article><p><b>One two three<br><p>Four", "One two three\n\nFour"),
        (f"<body><h1>Title</h1>{P}<p>Short.</p></body>", "Title\n\n" + re.sub("<.*?>", "", P) + "\n\nShort."),
        (f"<div class='top'><a href=a>Home</a> | <a href=b>News</a></div><div class=c><h1>T</h1><div>{P[3:-4]}</div></div><div><a href=c>Terms</a> <a href=d>Privacy</a></div>", "T\n\n" + re.sub("<.*?>", "", P)),
        ("<div>" * 9000 + "deep", ""),
        (f"<head><title>T</title><body><article><h1>H</h1>{P}</article>", "H\n\n" + re.sub("<.*?>", "", P)),
        (f"<head><meta name=x>Loose words of the page.<article>{P}</article>", re.sub("<.*?>", "", P)),
        *((f"<div class='{c}'>{P}</div><article><h1>H</h1>{P}</article><div class='{c}'>{P}</div>", "H\n\n" + re.sub("<.*?>", "", P)) for c in ("footer-content", "sidebar content", "cookie-notice-text", "comment-body")),
        (f"<article>{P}<div class='comment-body'>{P}</div></article>", re.sub("<.*?>", "", P)),
        (f"<div class='content-sidebar-wrap'><div class='content'>{P}</div><div class='sidebar'>{P}</div></div>", re.sub("<.*?>", "", P)),
        (f"<article><div class='entry-header'><h1>Top</h1></div>{P}</article>", "Top\n\n" + re.sub("<.*?>", "", P)),
        ("<article><p>Let <math><mi>x</mi></math> be a number.</p></article>", "Let x be a number."),
        ("<article><blockquote><p>To be or not.</p><footer>A play</footer></blockquote><footer>The end of it.</footer></article>", "To be or not.\n\nA play"),
    ],
)
def test_main_text(html, text):
    assert html_content.main_text(html) == text


def test_cut_changes_labels():
    """Words alone mislead: the cut gets right what signs get wrong."""
    weights = html_content.fit({})
    p = html_content.parsed(f"<nav>{P}</nav><article>{P}<p>Of 1999.</p><p>All rights reserved, she said.</p><ul><li><a href=x>Link</a></li></ul>{P}</article><div class='ad'>{P}</div>")
    want = [b["standing"] == "inside" for b in p.blocks]
    signs = [x > 0 for x in html_content.scores_of(p.blocks, weights)]
    assert html_content.content(p, weights) == want != signs and sum(a != b for a, b in zip(signs, want, strict=True)) >= 4


def test_classifier_learns_from_elements(spark):
    """Pages whose articles are lists and whose menus are paragraphs turn the weights of both."""
    prior = dict(zip(html_content.PRIOR, html_content.fit({}), strict=True))
    pages = [f"<nav>{P}{P}</nav><article><ul>{'<li>one of these' * 9}</ul></article><p>x{i}" for i in range(60)]
    frame = spark.createDataFrame([(h,) for h in [*pages, None, "", "<p>no element"]], "html string")
    got = dict(zip(html_content.PRIOR, html_content.train(frame), strict=True))
    assert got["item"] > prior["item"] + 0.5 and got["paragraph"] < prior["paragraph"] - 0.5
    assert list(html_content.train(frame.limit(0))) == list(prior.values())
    assert all(-html_content.MOST <= x <= html_content.MOST for x in html_content.scores_of(html_content.parsed(pages[0]).blocks, html_content.train(frame, sample=5)))


def test_long_pages_take_linear_time():
    import time

    began = time.perf_counter()
    html_content.main_text("".join(f"<div><p>{'some words here now ok. ' * (i % 5)}</p></div>" for i in range(20_000)))
    assert time.perf_counter() - began < 20


def test_pages(spark):
    d = spark.createDataFrame([(1, "u", f"<article>{P}</article>", "x"), (1, "u", None, "x"), (None, None, "<![if]><p", "x")], "page_id long, url string, html string, key string")
    got = html_content.extract(d).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert html_content.extract(d.limit(0)).count() == 0
