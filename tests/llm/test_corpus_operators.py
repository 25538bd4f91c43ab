"""Language models, near and line duplicates, search, pipeline: against brute force."""

from __future__ import annotations

import collections
import math
import os
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import components, deleted_interpolation, exchange, kneser_ney, line_dedup, maxscore, ngram_shards, simhash, skew
from paperloom.llm.catalog import ORACLES, QUERIES


def corpus(n, seed=0, words=60):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(80)]
    return [" ".join(r.choices(v, weights=[1 / (i + 1) for i in range(80)], k=r.randint(0, words))) for _ in range(n)]


def test_packed_counts():
    for a in ([], [0, 1, 254, 255, 256, 10**12, 124], [124] * 9):
        assert exchange.large(exchange.small(np.array(a, np.int64))).tolist() == a
    r = np.random.default_rng(0)
    for _ in range(200):
        a = r.integers(0, 2 ** r.integers(1, 40), r.integers(0, 50))
        assert (exchange.large(exchange.small(a)) == a).all()
        b = r.integers(0, 2**63, r.integers(0, 50)).astype(np.uint64)
        assert (exchange.expand(exchange.squeeze(b), "u8") == b).all()


def test_exchange(spark):
    """Sums and least numbers over trees of one to three levels, as a dictionary has them."""
    r = np.random.default_rng(5)
    blocks = {i: np.unique(r.integers(0, 2**63, 40).astype(np.uint64) % np.uint64(97) << np.uint64(57)) for i in range(20)}
    n = {i: r.integers(1, 300, len(k)) for i, k in blocks.items()}
    for fan, levels in ((64, 1), (5, 2), (3, 3)):
        tree = exchange.plan(len(blocks), 800, 30, fan)
        assert tree.levels == levels and all(b % a == 0 for a, b in zip(tree.ranges, tree.ranges[1:], strict=False))
        for kind, values in ((exchange.Sums(), lambda i: (n[i],)), (exchange.Least(), lambda i: (n[i].astype(np.int64), (n[i] % 2).astype("u1")))):
            rows = [m for i, k in blocks.items() for m in exchange.messages(i, k, values(i), kind, tree)]
            replies, tally = exchange.gather(spark.createDataFrame(rows, exchange.MESSAGE), kind, tree, "test")
            back = {c: exchange.whole(g, kind) for c, g in by_child(replies.toArrow()).items()}
            every = collections.defaultdict(list)
            for i, k in blocks.items():
                for key, *v in zip(k.tolist(), *values(i), strict=True):
                    every[key].append(v)
            assert set(back) == set(blocks)
            for i, k in blocks.items():
                if isinstance(kind, exchange.Sums):
                    assert back[i][0].tolist() == [sum(v[0] for v in every[x]) for x in k.tolist()] and tally == len(every)
                else:
                    more = [any(v[1] for v in every[x]) or len({v[0] for v in every[x]}) > 1 for x in k.tolist()]
                    assert back[i][1].tolist() == more and back[i][0].tolist() == [min(v[0] for v in every[x]) if m else 0 for x, m in zip(k.tolist(), more, strict=True)]


def by_child(table):
    import pyarrow.compute as pc

    return {c: table.filter(pc.equal(table.column("child"), c)) for c in set(table.column("child").to_pylist())}


def test_messages_grow_with_the_input():
    """Sixteen times the blocks, each as large as before: sixteen times the messages, of the same size."""
    r = np.random.default_rng(6)
    keys = np.unique(r.integers(0, 2**64, 100_000, np.uint64))
    ones = (np.ones(len(keys), np.int64),)
    sent = {}
    for blocks in (300, 4800, 76_800):
        tree = exchange.plan(blocks, blocks * len(keys), 75_000)
        each = len(list(exchange.messages(1, keys, ones, exchange.Sums(), tree)))
        # A node of level k sends a message to each of its ranges of level k + 1.
        sent[blocks] = blocks * each + sum(tree.nodes(k) * tree.ranges[k] // tree.ranges[k - 1] for k in range(1, tree.levels))
    assert sent[4800] < 1.5 * 16 * sent[300] and sent[76_800] < 2.5 * 16 * sent[4800]
    assert sent[76_800] < 76_800 * 3 * 2 * exchange.FAN


@pytest.mark.parametrize("order", [1, 2, 3])
def test_deleted_interpolation(make, monkeypatch, order):
    monkeypatch.setattr(ngram_shards, "NODE_KEYS", 400)
    texts = [*corpus(120), None, ""]
    docs = make(texts).withColumn("tr", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)
    got = {r.doc_id: r for r in deleted_interpolation.score_texts(docs, "tr", keep=["doc_id"], order=order, block_tokens=300, fan=3).collect()}
    train = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))}
    tokens = {i: [x.encode() for x in (t or "").lower().split()] + ["END"] for i, t in enumerate(texts)}
    counts = [collections.Counter() for _ in range(order + 1)]
    for i, t in tokens.items():
        if train[i]:
            padded = ["BOS"] * (order - 1) + t
            for j in range(len(t)):
                for k in range(1, order + 1):
                    counts[k][tuple(padded[j + order - k : j + order])] += 1
    n, kinds, starts = sum(counts[1].values()), len(counts[1]), sum(train.values())
    assert len(got) == len(texts)

    def seen(t, j, less):
        """(estimates by order, bucket) of token j with ``less`` occurrences left out."""
        padded, out = ["BOS"] * (order - 1) + t, []
        for k in range(1, order + 1):
            gram = tuple(padded[j + order - k : j + order])
            above = n if k == 1 else starts if set(gram[:-1]) == {"BOS"} else counts[k - 1][gram[:-1]]
            out.append(max(counts[k][gram] - less, 0) / max(above - less, 1))
        return out, 1 + (above - less).bit_length() - 1 if above - less > 0 else 0

    cells: dict = {}
    for i, t in tokens.items():
        for j in range(len(t)) if train[i] else ():
            e, b = seen(t, j, 1)
            logs = [math.log2(x * (kinds + 1)) if x else -math.inf for x in e]
            cells.setdefault((b, *(deleted_interpolation.step(np.array(logs)).tolist())), []).append(logs)
    ratios = np.array([[2 ** (sum(x) / len(x)) if x[0] > -math.inf else 0.0 for x in zip(*v, strict=True)] for v in cells.values()])
    weights = deleted_interpolation.learn(np.array([c[0] for c in cells]), ratios, np.array([len(v) for v in cells.values()], float), order)
    for i, t in tokens.items():
        want = 0.0
        for j in range(len(t)):
            e, b = seen(t, j, 0)
            want += math.log10(weights[b] @ [*e, 1 / (kinds + 1)])
        assert got[i].score == pytest.approx(want, rel=1e-4)
    better = [0.0, 0.0]
    for i, t in tokens.items():
        base = sum(math.log10((counts[1][(w,)] + 0.5) / (n + 0.5 * (kinds + 1))) for w in t)
        r = got[i]
        assert r.base_score == pytest.approx(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[1][(w,)] > 0 for w in t), n)
        assert r.score < 0 and math.isfinite(r.score)
        if not train[i]:
            better[0] += base
            better[1] += r.score
    assert better[1] > better[0] * 1.1


def test_weights_by_expectation_maximisation():
    """Events drawn from known weights give these weights back."""
    r = np.random.default_rng(1)
    ratios = 2.0 ** r.integers(-9, 9, (400, 2)) * (r.random((400, 2)) < 0.9)
    scaled = np.c_[ratios, np.ones(400)] / np.c_[ratios, np.ones(400)].sum(0)  # three distributions over 400 outcomes
    n = np.rint(1e7 * scaled @ [0.5, 0.3, 0.2])
    scaled /= scaled[:, 2:]
    w = deleted_interpolation.learn(np.full(400, 3), scaled[:, :2], n, 2)
    assert w.shape == (deleted_interpolation.BUCKETS, 3) and np.allclose(w.sum(1), 1) and (w[3] == w[9]).all()
    assert np.allclose(w[3], [0.5, 0.3, 0.2], atol=0.02)
    assert (deleted_interpolation.learn(np.zeros(0), ratios[:0], n[:0], 2)[:, -1] == 1).all()


def test_deleted_interpolation_odd(odd):
    for flag in (True, False):
        got = deleted_interpolation.score_texts(odd.withColumn("tr", F.lit(flag)), "tr", keep=["doc_id", "n"]).collect()
        assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got) and {r.n_known > 0 for r in got} == {flag}
    assert deleted_interpolation.score_texts(odd.limit(0).withColumn("tr", F.lit(True)), "tr", keep=["doc_id"]).count() == 0


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([(t,) for t in corpus(30)], "text string")
    model = kneser_ney.train(texts, 3).toPandas()
    ids = model.id.values.astype(np.uint64)
    by = np.argsort(ids)
    ids, value = ids[by], model.value.values[by]
    assert len(set(ids)) == len(ids) and (value > 0).all() and (value <= 1).all()

    def look(x):
        j = min(np.searchsorted(ids, x), len(ids) - 1)
        return value[j] if ids[j] == x else None

    for context in (b"w1", b"w", b"zz", b""):
        total = 0.0
        for c in range(256):
            flat, place = kneser_ney.spell([context + bytes([c]) if c != kneser_ney.EDGE else context])
            key = kneser_ney.grams(flat, place, 3)[len(context)]
            p = 1 / 256
            for g, h in kneser_ney.parts(np.array([key]), 3):
                gamma = look(h[0])
                p = (look(g[0]) or 0.0) + (1.0 if gamma is None else gamma) * p
            total += p
        assert total == pytest.approx(1)


def test_perplexities_as_a_direct_model(make, spark, monkeypatch):
    """Counts, discounts, lower orders and sums worked out in plain Python, for several orders, over small blocks and shards."""
    monkeypatch.setattr(kneser_ney, "SHARD_KEYS", 40)
    monkeypatch.setattr(kneser_ney, "MESSAGES", 2)
    texts = [*corpus(25, 8, 40), "Ünder över w1 w1", "w1"]
    others = [*corpus(15, 9, 40), None, "", "quite other words", "ünder w2 𝛼"]
    for order in (1, 2, 4):
        grams = collections.Counter()
        for t in texts:
            for w in t.encode().split():
                padded = b"\n" * (order - 1) + w + b"\n"
                grams.update(padded[i : i + order] for i in range(len(w) + 1))
        levels = {order: grams}
        for k in range(order, 1, -1):
            levels[k - 1] = collections.Counter(g[1:] for g in levels[k])  # distinct left neighbours
        table = {}
        for k, counts in levels.items():
            c = [0, *(sum(n == i for n in counts.values()) for i in (1, 2, 3, 4))]
            y = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
            d = [0, *(min(max(i - (i + 1) * y * c[i + 1] / c[i] if c[i] else 0.5 * i, 0.1), i - 0.05) for i in (1, 2, 3))]
            total, left = collections.Counter(), collections.Counter()
            for g, n in counts.items():
                total[g[:-1]] += n
                left[g[:-1]] += d[min(n, 3)]
            table[k] = counts, d, total, left

        def prob(g, table=table):
            if not g:
                return 1 / 256
            counts, d, total, left = table[len(g)]
            h = g[:-1]
            lower = prob(g[1:])
            return lower if not total[h] else (counts[g] - d[min(counts[g], 3)]) / total[h] + left[h] / total[h] * lower

        model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), order)
        got = {r.doc_id: r for r in kneser_ney.perplexities(make(others), model, keep=["doc_id"], order=order, block_words=60).collect()}
        for i, t in enumerate(others):
            want, n = 0.0, 0
            for w in (t or "").encode().split():
                padded = b"\n" * (order - 1) + w + b"\n"
                want += sum(math.log10(prob(padded[j : j + order])) for j in range(len(w) + 1))
                n += len(w) + 1
            assert got[i].n_bytes == n and got[i].log10_prob == pytest.approx(want, rel=1e-4) and got[i].perplexity == pytest.approx(10 ** (-want / max(n, 1)), rel=1e-4)


def test_quality_classifier(make, spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_KEYS", 40)
    monkeypatch.setattr(kneser_ney, "MESSAGES", 2)
    monkeypatch.setattr(kneser_ney.perplexities, "__kwdefaults__", kneser_ney.perplexities.__kwdefaults__ | {"block_words": 200})
    clean = [t for t in corpus(150, 4) if len(t.split()) > 10]
    junk = [t.upper().replace(" ", "!! ") for t in clean[:20]]
    docs = make([*clean, *junk, None, "", " "])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, len(clean), 2)] + [(len(clean), 0, 0), (1, 1, 1), (3, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert sum(got[i].kept for i in range(len(clean))) >= 0.97 * len(clean) and not any(got[len(clean) + i].kept for i in range(20))
    assert all(got[i].kept and got[i].perplexity == 1 for i in range(len(clean) + 20, len(clean) + 23))
    assert kneser_ney.classify(docs, labels.limit(0)).filter("not kept").count() == 0
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0


def test_quality_classifier_odd(odd, spark):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert kneser_ney.classify(odd, labels).count() == odd.count()


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_anchors_cover():
    code = simhash.Anchors()
    r = np.random.default_rng(0)
    fp = r.integers(-(2**63), 2**63 - 1, 500)
    row, anchor = code.reach(fp)
    to = {i: set(anchor[row == i].tolist()) for i in range(500)}
    assert sum(map(len, to.values())) == len(row)  # none twice
    for i in range(500):
        for _ in range(20):
            mask = int(np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 2).astype(np.uint64)))
            y = np.array([(int(fp[i]) % 2**64) ^ mask], np.uint64).view(np.int64)
            assert int(code.home(y)[0]) in to[i] and int(code.home(fp[i : i + 1])[0]) in set(code.reach(y)[1].tolist())


def test_fingerprints_of_distinct_words():
    a, b = simhash.fingerprint("a b c b a a", 1, True), simhash.fingerprint("C b A", 1, True)
    assert a == b != simhash.fingerprint("a b c b a a", 1) and simhash.fingerprint("a b a b a", 2, True) == simhash.fingerprint("b a b a", 2, True)
    h = [xxhash.xxh64_intdigest(w, 42) for w in (b"a", b"b", b"c")]
    assert a == sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) > 1.5) and simhash.fingerprint(None, 1, True) == 0


@pytest.mark.parametrize("dense", [200_000, 10])
def test_local_roots(dense):
    r = np.random.default_rng(2)
    fp = np.unique(np.array([r.integers(0, 2**63) for _ in range(6)] * 20, np.uint64) ^ (np.uint64(1) << r.integers(0, 60, 120).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 60, 120).astype(np.uint64)))
    r.shuffle(fp)
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if int(np.bitwise_count(fp[i] ^ fp[j])) <= 2]
    assert simhash.local_roots(fp, dense).tolist() == union(len(fp), pairs)


def test_near_links(spark):
    """Planted chains and clusters, with all links of brute force."""
    r = random.Random(6)
    values = {0, 2**64 - 1}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(50):
            x ^= 1 << r.randrange(64) if r.random() < 0.7 else 1 << r.randrange(64) | 1 << r.randrange(64)
            values.add(x)
    center = r.getrandbits(64)
    values |= {center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)} | {r.getrandbits(64) for _ in range(300)}
    fps = sorted(np.array(sorted(values), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components.components(simhash.near_links(df)).collect()}
    u = np.array(fps).view(np.uint64)
    pairs = [(i, int(j)) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[:i]) <= 2)]
    root = union(len(u), pairs)
    assert [got.get(x, x) for x in fps] == [fps[i] for i in root]


def test_simhash(make, odd):
    texts = corpus(40, 8, 200) + corpus(20, 8, 200) + [None, "", "a b", "A  B", "a"]
    df = make(texts)
    got = {r.doc_id: r for r in simhash.groups(df).collect()}
    f = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == f
    assert [got[i].component for i in range(len(texts))] == union(len(f), [(i, j) for i in range(len(f)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= 2])
    one = simhash.keep_one(df)
    assert one.columns == df.columns and {r.doc_id for r in one.collect()} == {r.component for r in got.values()}
    assert simhash.groups(odd).count() == odd.count() and simhash.keep_one(odd).count() == len({r.component for r in simhash.groups(odd).collect()})
    assert simhash.groups(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_of_null_and_repeated_ids(make):
    """Different texts stay though their ids are null or the same; of copies one stays."""
    a, b, c, d, e = (" ".join(f"{x}{k * k}" for k in range(60)) for x in "abcde")
    df = make([a, b, a.upper(), c, d, d, d, e, e], [None, None, None, 7, 7, 7, 8, None, 9])
    assert len({r.fp for r in simhash.groups(df).collect()}) == 5
    got = simhash.keep_one(df).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got) == sorted([(0, a), (0, b), (7, c), (7, d), (9, e)])
    assert simhash.groups(df).columns == ["doc_id", "fp", "component"]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    root = union(3000, edges)
    assert got == {x: root[x] for e in edges for x in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_lookup(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 5)
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("none", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("hot", "x", 50), ("cold", "y", 1)], "k string, w string, n long")
    for how, n in (("inner", 51), ("left", 53)):
        got = skew.split_lookup(left, right, "k", "n", how).collect()
        assert len(got) == n and {(r.k, r.w) for r in got if r.w} == {("hot", "x"), ("cold", "y")}


def small_blocks(monkeypatch):
    monkeypatch.setattr(line_dedup, "NODE_KEYS", 20)
    monkeypatch.setattr(line_dedup.repeats, "__kwdefaults__", line_dedup.repeats.__kwdefaults__ | {"block_words": 100, "fan": 3})


def test_line_dedup(make, odd, monkeypatch):
    small_blocks(monkeypatch)
    r = random.Random(9)
    lines = [" ".join(f"x{r.randrange(9)}" for _ in range(r.choice([3, 8]))) for _ in range(30)]
    texts = ["\n".join(r.choice(lines) + r.choice(["", " ", "\r"]) for _ in range(r.randint(0, 4))) for _ in range(60)] + [None, ""]
    df = make(texts)
    seen, want, left = {}, set(), {}
    for i, t in enumerate(texts):
        pos, keep = 0, []
        for x in (t or "").split("\n"):
            k = tuple(x.lower().split())
            gone = len(k) >= 5 and k in seen
            if gone:
                want.add((i, pos, pos + len(x), len(k), seen[k]))
            elif len(k) >= 5:
                seen[k] = i
            keep += [] if gone else [x]
            pos += len(x) + 1
        left[i] = keep
    got = line_dedup.repeats(df, least=5).collect()
    assert {(x.key, x.start, x.end, x.n_words, x.kept_key) for x in got} == want and len(got) == len(want)
    out = {x.doc_id: x.text for x in line_dedup.remove(df, least=5).collect()}
    assert line_dedup.remove(df, least=5).columns == df.columns
    assert all((out[i] or "").rstrip("\n") == "\n".join(left[i]).rstrip("\n") for i in range(len(texts)))
    assert line_dedup.remove(odd).count() == odd.count() and line_dedup.repeats(df.limit(0)).count() == 0
    same = line_dedup.repeats(odd, least=3).collect()
    assert {(x.key, x.kept_key) for x in same} == {(5, 5), (6, 5)}  # the long text repeats itself; the rows of id 7 are one document


def test_short_lines_by_default(make, monkeypatch):
    """As brute force: every later equal line goes, of one word or more, with unique neighbours or none."""
    small_blocks(monkeypatch)
    r = random.Random(12)
    lines = [" ".join(f"y{i}x{k}" for k in range(n)) for i, n in enumerate([1, 1, 2, 3, 5, 7, 9, 12, 19, 20, 25])]
    texts = []
    for i in range(50):
        some = [f"own{i}a{k} only here" if k % 2 == 0 else r.choice(["", " ", r.choice(lines), r.choice(lines).upper()]) for k in range(r.randint(0, 6))]
        texts.append("\n".join(some))
    texts += lines + [None, ""]
    seen, want, left = {}, set(), {}
    for i, t in enumerate(texts):
        pos, left[i] = 0, []
        for x in (t or "").split("\n"):
            k = tuple(x.lower().split())
            if k and k in seen:
                want.add((i, pos, pos + len(x), len(k), seen[k]))
            else:
                seen.setdefault(k, i)
                left[i].append(x)
            pos += len(x) + 1
    got = line_dedup.repeats(make(texts)).collect()
    assert {(x.key, x.start, x.end, x.n_words, x.kept_key) for x in got} == want and len(got) == len(want)
    assert {n for *_, n, _ in want} == {1, 2, 3, 5, 7, 9, 12, 19, 20, 25}
    out = {x.doc_id: x.text for x in line_dedup.remove(make(texts)).collect()}
    assert all((out[i] or "").rstrip("\n") == "\n".join(left[i]).rstrip("\n") for i in range(len(texts)))


def test_passages(make, monkeypatch):
    """Planted passages inside lines: all copies but the first go, but for a few words at the ends; the rest stays."""
    small_blocks(monkeypatch)
    r = random.Random(10)
    some = lambda n: [r.choice("abcdefgh") + str(r.randrange(500)) for _ in range(n)]
    passages = [some(n) for n in (50, 50, 51, 64, 120)]
    texts, planted = [], []
    for i in range(60):
        w = some(r.randint(0, 90))
        for n, k in enumerate(r.sample(range(5), r.choice([0, 0, 1, 2]))):
            at = len(w) if n else r.randint(0, len(w))
            w[at:at] = [x.upper() for x in passages[k]] if r.random() < 0.5 else passages[k]
            planted.append((i, k))
        texts.append("".join(x + r.choice([" ", " ", " ", "\n", "  "]) for x in w))
    texts += [None, "", "é𝛼 " * 30, " ".join(some(30)), "go on " * 100, "Orre " * 200]
    got = line_dedup.repeats(make(texts), least=1000).collect()
    words = [[x.lower() for x in (t or "").split()] for t in texts]
    where = {}
    for i, w in enumerate(words):
        for j in range(len(w) - line_dedup.WINDOW + 1):
            where.setdefault(tuple(w[j : j + line_dedup.WINDOW]), (i, j))
    gone = {}
    for x in got:
        before = len(texts[x.key][: x.start].split())
        part = texts[x.key][x.start : x.end].lower().split()
        assert x.n_words == len(part) >= line_dedup.RUN and part == words[x.key][before : before + len(part)]
        for j in range(before, before + len(part) - line_dedup.WINDOW + 1):  # all that goes has an earlier equal
            assert where[tuple(words[x.key][j : j + line_dedup.WINDOW])] < (x.key, j)
        gone.setdefault(x.key, []).append((before, before + len(part)))
    first = {}
    for i, k in sorted(planted):
        n = len(passages[k])
        at = next(j for j in range(len(words[i])) if words[i][j : j + n] == passages[k])
        covered = sum(max(0, min(b, at + n) - max(a, at)) for a, b in gone.get(i, []))
        assert covered == 0 if first.setdefault(k, i) == i else covered >= n - 2 * (line_dedup.REACH - 1)
    assert set(gone) <= {i for i, _ in planted} | {len(texts) - 2, len(texts) - 1} and {len(texts) - 2, len(texts) - 1} <= set(gone)
    out = {x.doc_id: x.text for x in line_dedup.remove(make(texts), least=1000).collect()}
    for i, t in enumerate(texts):
        left = [w for j, w in enumerate(words[i]) if not any(a <= j < b for a, b in gone.get(i, []))]
        assert (out[i] or "").lower().split() == left and (i in gone or out[i] == t)


def test_passage_words_by_chunks(monkeypatch):
    """Hashes don't depend on where long texts are cut."""
    t = "".join(random.Random(3).choices("aA é\n\t𝛼b", k=3000)) + "x" * 300 + " y"
    h = line_dedup.Units().words(t)
    monkeypatch.setattr(line_dedup, "CHUNK", 64)
    assert all((a == b).all() for a, b in zip(h, line_dedup.Units().words(t), strict=True))
    by = {}
    for x, s, e in zip(*h[:3], strict=True):
        assert by.setdefault(x, t[s:e].encode().lower()) == t[s:e].encode().lower()
    assert len(by) == len(set(by.values())) and [t[s:e] for s, e in zip(*h[1:3], strict=True)] == t.split()


def test_search(spark):
    r = np.random.default_rng(3)
    v = np.round(r.normal(0, 1, (300, 12)), 2)
    v[40:60] = v[7]
    rows = [(i, [float(x) for x in v[i]], 1, "x") for i in range(300)]
    rows += [(None, [1.0] * 12, 1, "x"), (300, None, 1, "x"), (301, [float("nan")] * 12, 1, "x"), (302, [None] * 12, 1, "x"), (303, [float("inf")] * 12, 1, "x"), (304, [], 1, "x"), (350, [0.5], 1, "x"), (50, rows[50][1], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    got = {(x.query_id, x["rank"], x.vec_id, x.score) for x in maxscore.top_k(df, "id % 50 = 0", shard_rows=37, query_rows=3).collect()}
    full = [(i, [math.floor(256 * x) for x in e] + [0] * (12 - len(e))) for i, e, *_ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = set()
    for q, a in {(i, tuple(e)) for i, e in full if i % 50 == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, e, strict=True)), i) for i, e in full if i != q)[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    few = maxscore.top_k(df.filter("vec_id in (0, 3)"), "id % 50 = 0").collect()
    assert [(x.query_id, x.vec_id) for x in few] == [(0, 3)]
    assert maxscore.top_k(df.limit(0), "id % 50 = 0").count() == 0
    big = spark.createDataFrame([(0, [2.0**20, 3.0]), (1, [2.0**20, 1.0 / 256]), (2, [-(2.0**20), 1.0])], "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.score) for x in maxscore.top_k(big, "id = 0").orderBy("rank").collect()] == [(1, 2**56 + 768), (2, 768 * 256 - 2**56)]


def test_pipeline(spark, make, odd):
    good = lambda k: " ".join(f"the word{k}x{i}" for i in range(30))
    shared = " ".join(f"shared{i} the" for i in range(30))
    texts = [good(1), good(1), good(2) + "\n" + shared, good(3) + "\n" + shared + "\ntoken=abcdefghijklmnop1", "junk", None, good(4).upper()]
    docs = make(texts)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, ""), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            seen[name] = {r.doc_id: r.text for r in out.collect()}
            docs = out
    assert set(seen["quality_rules"]) == {0, 1, 2, 3} and set(seen["simhash_near_dedup"]) == {0, 2, 3}
    assert shared in seen["line_dedup"][2] and shared not in seen["line_dedup"][3]
    assert "abcdefghijklmnop1" not in seen["secret_scan"][3] and seen["secret_scan"][0] == texts[0]
    assert {r.doc_id for r in out.collect()} == {0, 2, 3}
    for frame in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, "").count() >= 0


def test_stages_keep_columns_of_any_type(spark):
    more = {
        "da y": "date'2020-01-02'", "de.c": "1.5BD", "ts": "timestamp'2020-01-02 03:04:05'", "nt": "timestamp_ntz'2020-01-02 03:04:05'", "iv": "interval '1' day", "st": "struct(1 as a, array('x') as b)",
        "mp": "map('k', 2)", "bi": "cast('12' as binary)", "bo": "cast(null as boolean)", "nest": "array(struct(map(1, 2) as z))", "ti": "3Y", "key": "'k'", "row": "1", "fp": "2", "c0": "4",
    }
    texts = [(i, " ".join(f"the word{i}x{k}" for k in range(30)) if i % 2 else None) for i in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({k: F.expr(v) for k, v in more.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert sorted(map(repr, out.collect())) == sorted(repr(r) for r in docs.collect() if r.text or name in ("line_dedup", "secret_scan") or (name == "simhash_near_dedup" and r.doc_id == 0))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 6


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want)) and want


def test_queries_are_registered():
    assert sorted(QUERIES) == sorted(["pipeline", *(n for n in QUERIES if n.startswith("op"))]) and len(QUERIES) == 11
