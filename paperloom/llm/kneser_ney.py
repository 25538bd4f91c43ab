"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The n-grams are those of the UTF-8 bytes of words between ASCII white space,
a boundary byte standing before and after each word, so any text has a score
and a word's probability doesn't depend on its neighbours. An n-gram of up to
six bytes is exact in a 64-bit key. The model is trained on trusted text
(labelled of good quality and not toxic; at most SAMPLE documents, so that
their keys may be broadcast and no text is shuffled to meet its label): counts
of the highest order, numbers of distinct left neighbours below it, three
discounts an order.

Scores come from sharded joins: documents are packed into blocks, a block asks
for each distinct n-gram of its distinct words once, by messages to the shards
of the model table, and the answers are joined back to the block, which adds
up its documents. Messages to a shard are split over as many copies of it as
their number demands. Neither the model nor a vocabulary is broadcast. Blocks
are named by a digest of their content, so the second scan, which brings them
to the answers, names them alike; a block whose answers aren't there is an error.

A document is kept if its perplexity is at most its language's threshold, set
from quantiles among trusted documents that the model wasn't trained on: the
median plus ``spread`` times the distance from there to the upper quantile. A
language with fewer than ``least`` such documents takes the overall threshold.

Defined results: a null text or one without words has perplexity 1 and is
kept; a null language takes the overall threshold; without trusted text all
are kept (every byte is equally likely); repeated rows are judged alike;
several labels of one document make it trusted if all of them do; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_map import bounded_batches, lean, schema_of
from .exchange import dealt as mixed
from .exchange import expand, mix, rows_to_batches, squeeze, together
from .session import cut, read_table
from .skew import split_lookup

ORDER = 5
EDGE = 10  # the line feed never occurs in a word
BLOCK_WORDS = 1_000_000
SHARD_KEYS = 400_000
MESSAGES = 48
#: Most trusted documents that the model is trained on, those of least hash.
SAMPLE = 10_000


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the words, each followed by EDGE, and for every byte its place in its word."""
    flat = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    ends = np.flatnonzero(flat == EDGE)
    starts = np.r_[0, ends[:-1] + 1]
    return flat, np.arange(len(flat)) - np.repeat(starts, ends - starts + 1)


def grams(flat: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Key of the ``order`` bytes that end at each byte; EDGE stands for all before the word."""
    key = np.zeros(len(flat), np.uint64)
    for j in range(order - 1, -1, -1):
        part = np.full(len(flat), EDGE, np.uint64)
        if j < len(flat):
            part[j:] = np.where(place[j:] >= j, flat[: len(flat) - j], EDGE)
        key = key << np.uint64(8) | part
    return key


def name(order: int, key: np.ndarray, context: bool = False) -> np.ndarray:
    """Keys of all orders and kinds in one space."""
    return key.astype(np.uint64) | np.uint64((order + 8 * context) << 56)


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(ids, ids) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def counted(texts: DataFrame, order: int) -> DataFrame:
    """(key, n): occurrences of the n-grams of the highest order in column ``text``."""
    bounded_batches(texts.sparkSession)
    kind, arrow = schema_of("key long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, int] = {}
            for t in b.column(0).to_pylist():
                for w in t.encode("utf-8", "surrogatepass").split() if t else ():
                    seen[w] = seen.get(w, 0) + 1
            if seen:
                flat, place = spell(list(seen))
                sizes = np.fromiter((len(w) + 1 for w in seen), np.int64, len(seen))
                key, where = np.unique(grams(flat, place, order), return_inverse=True)
                n = np.bincount(where, weights=np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], schema=arrow)

    return texts.select("text").mapInArrow(run, kind).groupBy("key").agg(F.sum("n").alias("n"))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, F.lit(d[0])).when(n == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(id, value): discounted probabilities of n-grams, and the weight each context leaves to the order below."""
    now = cut(counted(texts, order), "grams")
    parts = []
    for k in range(order, 0, -1):
        r = now.groupBy().agg(*[F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)).alias(f"c{i}") for i in (1, 2, 3, 4)]).first()
        y = r["c1"] / (r["c1"] + 2 * r["c2"]) if r["c1"] and r["c2"] else 0.5
        d = tuple(min(max(i - (i + 1) * y * r[f"c{i + 1}"] / r[f"c{i}"] if r[f"c{i}"] else 0.5 * i, 0.1), i - 0.05) for i in (1, 2, 3))
        context = F.shiftrightunsigned("key", 8)
        n = F.col("n")
        sums = now.groupBy(context.alias("context")).agg(F.sum("n").alias("s"), F.sum(_discount(n, d)).alias("left"))
        sums = cut(sums, "contexts") if k > 1 else sums
        tag = lambda extra, k=k: F.lit((k + extra) << 56)
        met = now.withColumn("context", context).join(sums if k > 1 else F.broadcast(sums), "context")  # of order 1, one row
        parts.append(met.select(F.col("key").bitwiseOR(tag(0)).alias("id"), ((n - _discount(n, d)) / F.col("s")).alias("value")))
        parts.append(sums.select(F.col("context").bitwiseOR(tag(8)).alias("id"), (F.col("left") / F.col("s")).alias("value")))
        if k > 1:
            now = cut(now.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("n")), "grams")
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    return cut(model, "model")


def longest(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the highest order, sorted and distinct; each byte's position among them; and where words start.

    All shorter n-grams and contexts are parts of these.
    """
    flat, place = spell(words)
    distinct, inverse = np.unique(grams(flat, place, order), return_inverse=True)
    return distinct, inverse.astype(np.int32), np.flatnonzero(place == 0)


def parts(keys: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For orders from 1 up the ids of the n-grams and of their contexts, for each key of the highest order."""
    for k in range(1, order + 1):
        low = keys & np.uint64((1 << 8 * k) - 1)
        yield name(k, low), name(k, low >> np.uint64(8), True)


def make_blocks(docs: DataFrame, *, text: str, keep: list[str], block_words: int) -> DataFrame:
    """(block, words, codes, sizes, keep as arrays): distinct words, codes into them, words per document; ``block`` is a digest of all that."""
    bounded_batches(docs.sparkSession)
    kind, arrow = schema_of("block long, words binary, codes binary, sizes binary, " + ", ".join(f"`{c}` array<{docs.schema[c].dataType.simpleString()}>" for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words: dict[bytes, int] = {}
        codes: list[np.ndarray] = []
        kept: list[list] = [[] for _ in keep]
        held = 0

        def done() -> pa.RecordBatch:
            joined = np.frombuffer(b"\n".join(words), np.uint8) if words else np.zeros(0, np.uint8)
            flat = np.concatenate(codes)
            digest = xxhash.xxh3_64(joined.tobytes())
            digest.update(flat.tobytes())
            digest.update(repr(kept).encode())
            cells = [digest.intdigest() - (1 << 63), squeeze(joined), squeeze(flat), squeeze(np.array([len(c) for c in codes], np.int64)), *kept]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

        for b in batches:
            rest = [b.column(i).to_pylist() for i in range(1, b.num_columns)]
            for i, t in enumerate(b.column(0).to_pylist()):
                got = t.encode("utf-8", "surrogatepass").split() if t else []
                if held and held + len(got) >= block_words:
                    yield done()
                    words, codes, kept, held = {}, [], [[] for _ in keep], 0
                new = words.setdefault
                codes.append(np.array([new(w, len(words)) for w in got], np.int32))
                for k, values in zip(kept, rest, strict=True):
                    k.append(values[i])
                held += len(got) + 1
        if codes:
            yield done()

    return docs.select(text, *keep).mapInArrow(run, kind)


def words_of(row: dict) -> list[bytes]:
    joined = expand(row["words"], "u1").tobytes()
    return joined.split(b"\n") if joined else []


def asked_ids(words: list[bytes], order: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids that a block needs, by shard and in each in order, and their shards."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat, place = spell(words)
    ids = np.concatenate([np.unique(x) for pair in parts(np.unique(grams(flat, place, order)), order) for x in pair])
    ids.sort()
    to = shard_of(ids, shards)
    by = np.argsort(to, kind="stable")
    return ids[by], to[by]


def perplexities(docs: DataFrame, model: DataFrame, *, keep: list[str], text: str = "text", order: int = ORDER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """keep, n_bytes, log10_prob, perplexity: one row per row of ``docs``."""
    blocks = make_blocks(docs, text=text, keep=keep, block_words=block_words)
    shards = max(1, -(-model.count() // SHARD_KEYS))
    chars, ranges = docs.select(F.length(text).alias("n"), F.spark_partition_id().alias("p")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.countDistinct("p")).first()
    many = ranges + chars // (4 * block_words)  # about as many blocks, or more
    copies = max(1, -(-many // MESSAGES))  # a block sends a shard one message at most
    kind, arrow = schema_of("node long, shard long, block long, ids binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for row in b.to_pylist():
                ids, to = asked_ids(words_of(row), order, shards)
                some, starts = np.unique(to, return_index=True)
                for s, part in zip(some.tolist(), np.split(ids, starts[1:]), strict=True) if len(ids) else ():
                    yield s * copies + mixed(row["block"]) % copies, s, row["block"], squeeze(np.diff(part, prepend=np.uint64(0)))

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from rows_to_batches(ask(batches), arrow)

    dealt = blocks.select("block", "words").mapInArrow(messages, kind)
    put, row = schema_of("shard long, id long, value double")

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(ids, shards)), b.column(0), b.column(1)], schema=row)

    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))
    table = model.select("id", "value").mapInArrow(sharded, put).withColumn("copy", each).select((F.col("shard") * copies + F.col("copy")).alias("node"), "id", "value")
    back, told = schema_of("block long, shard long, found binary, value binary")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        ids = right.column("id").to_numpy().view(np.uint64)
        by = np.argsort(ids)
        ids, value = ids[by], right.column("value").to_numpy()[by].astype("<f4")
        out: list[list] = [[], [], [], []]
        for r in left.to_pylist():
            mine = np.cumsum(expand(r["ids"], "u8"), dtype=np.uint64)
            at = np.minimum(np.searchsorted(ids, mine), max(0, len(ids) - 1))
            hit = ids[at] == mine if len(ids) else np.zeros(len(mine), bool)
            for o, c in zip(out, (r["block"], r["shard"], squeeze(hit.astype("u1")), squeeze(value[at[hit]])), strict=True):
                o.append(c)
        return pa.Table.from_arrays([pa.array(o, f.type) for o, f in zip(out, told, strict=True)], schema=told)

    replies = together(dealt, "node", shards * copies).groupBy("node").cogroup(together(table, "node", shards * copies).groupBy("node")).applyInArrow(answer, back)
    extra = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    final, scored = schema_of(f"{extra}, n_bytes long, log10_prob double, perplexity double")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        out = []
        replies = sorted({r["shard"]: r for r in right.to_pylist()}.values(), key=lambda r: r["shard"])  # equal blocks ask alike
        for r in left.to_pylist():
            words = words_of(r)
            ids, _ = asked_ids(words, order, shards)
            known = np.full(len(ids), np.nan)
            if len(ids) and sum(int.from_bytes(x["found"][:8], "little") for x in replies) != len(ids):
                raise RuntimeError("a block was packed differently the second time")
            if len(ids):  # replies come in the order in which was asked
                known[np.concatenate([expand(x["found"], "u1") for x in replies]) > 0] = np.concatenate([expand(x["value"], "f4") for x in replies])
            by = np.argsort(ids)
            codes, sizes = expand(r["codes"], "i4"), expand(r["sizes"], "i8")
            score, size = word_scores(words, ids[by], known[by], order)
            ends = np.cumsum(sizes)
            total = np.r_[0.0, np.cumsum(score[codes])] if len(codes) else np.zeros(1)
            many = np.r_[0, np.cumsum(size[codes])] if len(codes) else np.zeros(1, np.int64)
            logs, n = total[ends] - total[ends - sizes], many[ends] - many[ends - sizes]
            cells = [*[r[c] for c in keep], n, logs, 10 ** (-logs / np.maximum(n, 1))]
            out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cells, scored, strict=True)], schema=scored))
        return pa.concat_tables(out) if out else pa.Table.from_batches([], schema=scored)

    return cut(together(blocks, "block", many).groupBy("block").cogroup(together(replies, "block", many).groupBy("block")).applyInArrow(meet, final), "perplexities")


def word_scores(words: list[bytes], ids: np.ndarray, known: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability and number of bytes (with the edge) of every word; ``known`` is NaN where the model has nothing."""
    if not words:
        return np.zeros(0), np.zeros(0, np.int64)
    keys, inverse, starts = longest(words, order)
    p = 1 / 256
    for gram, context in parts(keys, order):
        alpha = np.nan_to_num(known[np.searchsorted(ids, gram)], nan=0.0)
        p = alpha + np.nan_to_num(known[np.searchsorted(ids, context)], nan=1.0) * p
    return np.add.reduceat(np.log10(p)[inverse], starts), np.array([len(w) + 1 for w in words], np.int64)


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", upper: float = 0.99, spread: float = 2.0, least: int = 20, order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """key, lang, n_bytes, log10_prob, perplexity, threshold, kept: one row per row of ``docs``."""
    good = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("trusted")).filter("trusted").select(key)
    fold = F.pmod(F.xxhash64(F.col(key)), F.lit(2)) == 0
    some = good.filter(fold).orderBy(F.xxhash64(F.col(key), F.lit(1)), key).limit(sample)
    texts = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(some), key, "left_semi")  # at most ``sample`` keys
    model = train(texts.select("text"), order)
    got = perplexities(docs, model, keep=[key, lang], text=text, order=order)
    calm = got.filter(~fold & (F.col("n_bytes") > 0)).join(good, key, "left_semi")
    points = F.percentile_approx("perplexity", [0.5, upper], 10000).alias("q")
    bound = lambda: (F.col("q")[0] + spread * (F.col("q")[1] - F.col("q")[0]))
    overall = calm.agg(points).select(bound().alias("t")).first()["t"]
    each = calm.groupBy(lang).agg(points, F.count(F.lit(1)).alias("m")).filter(F.col("m") >= least).select(lang, bound().alias("own"))
    rows = got.groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    limits = cut(rows.join(each, lang, "left").select(lang, "n", "own"), "thresholds")
    told = split_lookup(got, limits, lang, "n", "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double"))).drop("own")
    return told.withColumn("kept", F.coalesce((F.col("n_bytes") == 0) | (F.col("perplexity") <= F.col("threshold")), F.lit(True)))


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return got.select("doc_id", "lang", "n_bytes", "log10_prob", "perplexity", "threshold", "kept")
