"""Repeated lines and passages across documents: hash units, group globally, keep the earliest.

Words are what stands between ASCII white space, A-Z lowered. Two kinds of
units are digested. A line of at least ``least`` words is one, by default every
line that has a word. Passages that start and end inside lines have no line of
their own, so windows of WINDOW words are units too: of every REACH windows in
sequence the one of least digest is taken, a choice that a passage's own words
decide wherever it stands. Of two equal passages of n words the same windows
are thus taken, and they cover all but REACH - 1 words at either end at most.
Repeated windows that overlap form a run; a run of RUN words or more is
removed. Any repeat of PASSAGE_WORDS or more has such a run, and nothing of
less than RUN words is touched unless it is a whole line.

Digests are grouped over all documents: texts are packed into blocks, a block
reports each of its distinct digests once, with the least key that has it
there, through the tree of :mod:`.exchange`, and is told the least key of all.
So a passage that a third of all documents hold costs one entry a block and
meets nowhere more often. The occurrence in the document of least key stays,
all others are removed; within a document the first stays and later ones that
don't overlap it are removed. Offsets into the original text (code points, end
exclusive) are kept in the result. Digests have 64 bits; a false run needs
several of its digests to collide.

Defined results: keys are integers; a null key ranks first; rows of one key
are one document, so they don't remove from each other; a null or empty text
has no units; other columns are ignored, or passed on by :func:`remove`; a text
of which everything repeats stays as what lies between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .arrow_map import bounded_batches, lean, map_batches, schema_of
from .exchange import expand, mix, squeeze
from .session import cut, drop_tables, free_name, read_table

LEAST_WORDS = 1
WINDOW, REACH = 16, 4
#: A repeat of PASSAGE_WORDS has a run of RUN at least.
PASSAGE_WORDS = 50
RUN = PASSAGE_WORDS - 2 * (REACH - 1)
BLOCK_WORDS = 1_000_000
NODE_KEYS = 1_000_000
#: Characters hashed at once.
CHUNK = 1 << 20
FIRST = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
LINE, PASSAGE = 0, 1


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


class _Sums:
    """Polynomial hashes of many slices of an array: differences of prefix sums, brought to one scale."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(a) > len(self.up):
            n = max(len(a), 2 * len(self.up))
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        total = np.r_[np.uint64(0), np.cumsum(a * self.up[: len(a)], dtype=np.uint64)]
        return mix((total[ends] - total[starts]) * self.down[np.minimum(starts, max(0, len(a) - 1))], (ends - starts).astype(np.uint64))


class Units:
    """The units of texts."""

    def __init__(self, least: int = LEAST_WORDS):
        self.least, self.sums = least, _Sums()
        letters = np.arange(128, dtype=np.uint32)
        letters[65:91] += 32
        self.lower = letters

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of the words, and the positions of line breaks."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        blank = (code == 32) | ((code >= 9) & (code <= 13))
        edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # whole words, about CHUNK characters of them
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
            a, b = starts[at], ends[to - 1]
            part = code[a:b].copy()
            small = part < 128
            part[small] = self.lower[part[small]]
            hashes[at:to] = self.sums((part.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), starts[at:to] - a, ends[at:to] - a)
            at = to
        return hashes, starts, ends, np.flatnonzero(code == 10)

    def __call__(self, text: str | None) -> tuple[np.ndarray, ...]:
        """(digest, start, end, first word, number of words, kind), lines first."""
        h, s, e, breaks = self.words(text) if text else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        n = len(h)
        edges = np.r_[0, np.searchsorted(s, breaks), n]
        some = np.flatnonzero(np.diff(edges) >= self.least)
        a, b = edges[some], edges[some + 1]
        begin, end = np.r_[0, breaks + 1], np.r_[breaks, len(text or "")]
        first, digest = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n >= RUN:
            w, k = h, 1
            while k < WINDOW:
                w = mix(w[:-k], w[k:])
                k *= 2
            taken = np.lib.stride_tricks.sliding_window_view(w, REACH).argmin(axis=1)
            first = np.unique(taken + np.arange(len(taken)))
            digest = w[first]
        return (
            np.r_[self.sums(h, a, b) ^ np.uint64(BASE), digest], np.r_[begin[some], s[first]], np.r_[end[some], e[first + WINDOW - 1]], np.r_[a, first],
            np.r_[b - a, np.full(len(first), WINDOW)], np.r_[np.full(len(some), LINE), np.full(len(first), PASSAGE)],
        )


#: What is known of each unit, in the order of :class:`Units`, and how it is kept.
FIELDS = (("digest", "u8"), ("start", "i8"), ("end", "i8"), ("first", "i4"), ("n", "i4"), ("kind", "u1"))


def make_blocks(docs: DataFrame, *, key: str, text: str, least: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, n_units, keys, rows, sizes and the fields of units): texts by blocks of a bounded number of words."""
    bounded_batches(docs.sparkSession)
    kind, arrow = schema_of("n_units long, keys binary, rows binary, sizes binary, " + ", ".join(f"`{n}` binary" for n, _ in FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        units = Units(least)
        keys: list[int] = []
        rows: list[int] = []
        got: list[tuple[np.ndarray, ...]] = []
        held = 0

        def done() -> pa.RecordBatch:
            flat = [np.concatenate([g[i] for g in got]).astype(t) for i, (_, t) in enumerate(FIELDS)]
            for i in (1, 2, 3):
                flat[i] = np.diff(flat[i], prepend=flat[i].dtype.type(0))
            sizes = np.array([len(g[0]) for g in got], np.int64)
            cells = [len(flat[0]), squeeze(np.array(keys, np.int64)), squeeze(np.array(rows, np.int64)), squeeze(sizes), *map(squeeze, flat)]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

        for b in batches:
            for k, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                u = units(t)
                if not len(u[0]):
                    continue
                keys.append(k)
                rows.append(r)
                got.append(u)
                held += max(len(t) // 6, 2 * len(u[0]))  # very short lines are more units than words by characters
                if held >= block_words:
                    yield done()
                    keys, rows, got, held = [], [], [], 0
        if got:
            yield done()

    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST)), row_hash(key, text), F.col(text))
    return source.mapInArrow(run, kind).withColumn("block", F.monotonically_increasing_id())


def row_hash(key: str, text: str):
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))


class Block:
    """A block's units with their documents, and its distinct digests."""

    def __init__(self, row: dict):
        self.keys, self.rows, sizes = (expand(row[c], "i8") for c in ("keys", "rows", "sizes"))
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.digest, *rest, self.n, self.kind = (expand(row[n], t) for n, t in FIELDS)
        self.start, self.end, self.first = (np.cumsum(x, dtype=x.dtype) for x in rest)
        self.key = self.keys[self.doc]
        self.order = np.lexsort((self.start, self.doc, self.key, self.digest))
        d = self.digest[self.order]
        self.heads = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
        self.distinct = d[self.heads]


def ask(blocks: DataFrame, tree: X.Tree) -> DataFrame:
    """Each distinct digest of a block with its least key there, and whether others have it, to the first level of the tree."""
    kind, arrow = schema_of(X.MESSAGE)
    least = X.Least()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for row in b.to_pylist():
                x = Block(row)
                k = x.key[x.order]
                first, last = k[x.heads], k[np.r_[x.heads[1:], len(k)] - 1]
                yield from X.messages(row["block"], x.distinct, (first, (last > first).astype("u1")), least, tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from X.rows_to_batches(rows(batches), arrow)

    return blocks.mapInArrow(run, kind)


def removed(x: Block, hit: np.ndarray, kept: np.ndarray, run: int = RUN) -> list[tuple[int, int, int, int, int]]:
    """(document, start, end, words, key kept) of what goes, from what is known of each distinct digest."""
    sizes = np.diff(np.r_[x.heads, len(x.order)])
    group = np.repeat(np.arange(len(x.heads)), sizes)
    order, doc, start = x.order, x.doc[x.order], x.start[x.order]
    best = np.where(hit, kept, np.int64(0))[group]
    later = hit[group] & (x.key[order] > best)
    # The first occurrence in its own document, which the order puts at the head of each run of one document.
    head = np.r_[True, (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])]
    own_end = x.end[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    again = ~head & (start >= own_end)
    gone = np.zeros(len(order), bool)
    whose = np.zeros(len(order), np.int64)
    gone[order] = later | again
    whose[order] = np.where(later, best, x.key[order])
    i = np.flatnonzero(gone)
    i = i[np.lexsort((x.first[i], x.kind[i], x.doc[i]))]
    if not len(i):
        return []
    first, last, doc, kind = x.first[i], x.first[i] + x.n[i], x.doc[i], x.kind[i]
    # Repeated windows that touch are one run; lines stay alone.
    new = np.r_[True, (doc[1:] != doc[:-1]) | (kind[1:] != PASSAGE) | (kind[:-1] != PASSAGE) | (first[1:] > last[:-1])]
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(i)] - 1
    ok = (kind[a] == LINE) | (last[b] - first[a] >= run)
    a, b = a[ok], b[ok]
    found = sorted(zip(doc[a].tolist(), x.start[i][a].tolist(), x.end[i][b].tolist(), first[a].tolist(), last[b].tolist(), whose[i][a].tolist(), strict=True))
    out: list[list[int]] = []
    for d, s, e, f, t, k in found:
        if out and out[-1][0] == d and s <= out[-1][2]:
            out[-1][2], out[-1][4] = max(e, out[-1][2]), max(t, out[-1][4])
        else:
            out.append([d, s, e, f, t, k])
    return [(d, s, e, t - f, k) for d, s, e, f, t, k in out]


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS, fan: int = X.FAN) -> DataFrame:
    """One row per removed part: (key, row, start, end, n_words, kept_key); parts of one text don't overlap."""
    blocks = cut(make_blocks(docs, key=key, text=text, least=least, block_words=block_words), "units")
    units, many = blocks.agg(X.total("n_units"), F.count(F.lit(1))).first()
    tree, values = X.plan(many, units, NODE_KEYS, fan), X.Least()
    replies, _ = X.gather(ask(blocks, tree), values, tree, "units")
    kind, arrow = schema_of("key long, row long, start int, end int, n_words int, kept_key long")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        out: list[list] = [[] for _ in arrow]
        for row in left.to_pylist():
            x = Block(row)
            kept, hit = X.whole(right, values)
            for d, s, e, n, k in removed(x, hit.astype(bool), kept):
                for c, v in zip(out, (x.keys[d], x.rows[d], s, e, n, k), strict=True):
                    c.append(int(v))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    left, right = X.with_replies(blocks, replies, many)
    got = left.cogroup(right).applyInArrow(meet, kind)
    null = lambda c: F.when(F.col(c) != FIRST, F.col(c)).alias(c)
    out = cut(got.select(null("key"), "row", "start", "end", "n_words", null("kept_key")), "repeats")
    drop_tables(docs.sparkSession, blocks, replies)
    return out


def remove(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs``, which is read twice, without the repeated parts (a whole line with its line break); all rows and columns stay."""
    names = docs.columns
    gone = repeats(docs, key=key, text=text, least=least)
    own, cuts = free_name(docs, "gone_row"), free_name(docs, "gone_spans")
    spans = gone.select("row", "start", "end").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    met = docs.withColumn(own, row_hash(key, text)).join(spans.withColumnRenamed("row", own).hint("merge"), own, "left").select(*[F.col(f"`{n}`") for n in names], cuts)
    at = names.index(text)

    def make():
        def clean(t, spans):
            if not spans or t is None:
                return t
            out, last = [], 0
            for s in spans:
                a, b = s["start"], s["end"]
                out.append(t[last:a])
                whole = (a == 0 or t[a - 1] == "\n") and t[b : b + 1] == "\n"
                last = b + 1 if whole or (t[b : b + 1] == " " and t[a - 1 : a] == " ") else b
            return "".join([*out, t[last:]])

        def f(b):
            gone = b.column(len(names)).to_pylist()
            return {n: [clean(t, g) for t, g in zip(b.column(i).to_pylist(), gone, strict=True)] if i == at else b.column(i) for i, n in enumerate(names)}

        return f

    return map_batches(met, make, docs.schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats(read_table(spark, sf_dir, "documents"))
    return got.select(F.col("key").alias("doc_id"), "start", "end", "n_words", F.col("kept_key").alias("kept_doc_id"))
