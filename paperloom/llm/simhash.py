"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has bit i set if over half of its shingles' hashes have.
The anchors are the words of a covering code on 61 of the 64 bits: the product
of two perfect Golay codes of length 23 and covering radius 3 and a perfect
Hamming code of length 15 and covering radius 1, so 2**35 anchors, among which
even very many fingerprints lie thin. Every fingerprint lies within the radius
of its home anchor in each part; one that differs from it in at most two bits
lies within the radius plus its differences in that part. So each fingerprint
goes to all anchors within covering radius plus threshold, the threshold being
shared by the parts (153 anchors on average), and any two that link meet at the
home of either. At an
anchor they are compared in full and contracted to local components, so no
anchor emits more rows than it got; the components are then joined globally.

Exact copies are one fingerprint throughout, and rows meet their component
again by a lookup that deals out hot fingerprints.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, linked like any other; with fewer words than a shingle has,
the whole sequence is the one shingle; repeated rows are in one component; a
null id is never a component's id unless all its ids are null; other columns
are ignored, or passed on by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_map import bounded_batches, lean, map_batches, schema_of
from .components import components
from .session import cut, free_name, read_table
from .skew import split_lookup

GOLAY = 0b110001110101  # generator polynomial of the [23, 12] code
HAMMING = 0b10011  # and of the [15, 11] code
THRESHOLD = 2


def fingerprint(text: str | None, width: int = 3, distinct: bool = False) -> int:
    """The bits set in over half of the hashes of the text's shingles; ``distinct`` counts each shingle once."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if distinct and width == 1:
        some = set(words)
        return majority(np.fromiter([digest(w, 42) for w in some], np.uint64, len(some)))
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64, n)
    return majority(np.unique(h) if distinct else h)


def majority(h: np.ndarray) -> int:
    bytes_ = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(bytes_[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): one row per row of ``docs``; fp holds the bits as a signed long."""

    def make():
        return lambda b: {"key": b.column(0), "fp": np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)}

    return map_batches(docs.select(key, text), make, f"key {docs.schema[key].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


class Perfect:
    """A perfect cyclic code: every word is within ``radius`` of exactly one code word."""

    def __init__(self, bits: int, generator: int, radius: int, beyond: int = THRESHOLD):
        self.bits, self.generator, self.check = bits, generator, generator.bit_length() - 1
        by = [np.array([sum(1 << i for i in c) for c in combinations(range(bits), w)], np.int64) for w in range(radius + beyond + 1)]
        low = np.concatenate(by[: radius + 1])
        self.leader = np.zeros(1 << self.check, np.int64)
        self.leader[self.syndrome(low)] = low
        self.far = []
        for p in by[radius + 1 :]:
            s = self.syndrome(p)
            n = np.bincount(s, minlength=1 << self.check)
            self.far.append((p[np.argsort(s, kind="stable")], np.cumsum(n) - n, n))

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        """The remainder by the generator."""
        x = x.copy()
        for i in range(self.bits - 1, self.check - 1, -1):
            x ^= ((x >> i) & 1) * (self.generator << (i - self.check))
        return x

    def words(self, x: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in x, code word, told by its upper bits): the nearest (0), or all at distance radius + ``beyond``."""
        s = self.syndrome(x)
        if not beyond:
            return np.arange(len(x)), (x ^ self.leader[s]) >> self.check
        p, start, n = self.far[beyond - 1]
        count = n[s]
        pos = np.repeat(np.arange(len(x)), count)
        nth = np.arange(len(pos)) - np.repeat(np.cumsum(count) - count, count)
        return pos, (x[pos] ^ p[start[s[pos]] + nth]) >> self.check


class Anchors:
    """The covering code, a product of perfect codes: home anchors, and all anchors within reach."""

    def __init__(self):
        self.parts = [Perfect(23, GOLAY, 3), Perfect(23, GOLAY, 3), Perfect(15, HAMMING, 1)]

    def name(self, fp: np.ndarray, beyond: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor): the anchors whose parts lie so far beyond the radius of their codes."""
        row, anchor, at = np.arange(len(fp)), np.zeros(len(fp), np.int64), 0
        for code, far in zip(self.parts, beyond, strict=True):
            pos, word = code.words((fp[row] >> at) & ((1 << code.bits) - 1), far)
            row, anchor, at = row[pos], anchor[pos] << (code.bits - code.check) | word, at + code.bits
        return row, anchor

    def home(self, fp: np.ndarray) -> np.ndarray:
        return self.name(fp, (0,) * len(self.parts))[1]

    def reach(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) for every anchor of every fingerprint: the parts share the threshold."""
        found = [self.name(fp, far) for far in product(range(THRESHOLD + 1), repeat=len(self.parts)) if sum(far) <= THRESHOLD]
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= THRESHOLD


def _masks() -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array([*one, *(a | b for a, b in combinations(one, 2))], np.uint64)


def local_roots(fp: np.ndarray, dense: int = 200_000) -> np.ndarray:
    """For each of the distinct fingerprints at one anchor, the position of its
    local component's first member. Breadth first; a chunk of comparisons is
    held at a time. From ``dense`` on, the neighbours of a fingerprint are
    looked up among all, which takes time in proportion to the group."""
    n = len(fp)
    root = np.full(n, -1)
    if n > dense:
        order = np.argsort(fp)
        there, masks = fp[order], _masks()
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        front = np.array([first])
        left = np.flatnonzero(root < 0) if n <= dense else None
        while len(front) and (left is None or len(left)):
            found = []
            if left is not None:
                size = max(1, 4_000_000 // max(1, len(left)))
                hit = np.zeros(len(left), bool)
                for i in range(0, len(front), size):
                    hit |= _near(fp[front[i : i + size], None], fp[None, left]).any(axis=0)
                front, left = left[hit], left[~hit]
            else:
                for i in range(0, len(front), 1000):
                    probe = (fp[front[i : i + 1000], None] ^ masks[None]).ravel()
                    at = np.minimum(np.searchsorted(there, probe), n - 1)
                    got = np.unique(order[at[there[at] == probe]])
                    got = got[root[got] < 0]
                    root[got] = first
                    found.append(got)
                front = np.concatenate(found)
            root[front] = first
    return root


def _links(anchor: np.ndarray, fp: np.ndarray, code: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """(fp, fp of its local root) at each of the whole, sorted anchors; rows that are their own root are left out."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    run = np.repeat(np.arange(len(starts)), sizes)
    some = np.bincount(run, weights=code.home(fp.view(np.int64)) == anchor, minlength=len(starts)) > 0
    good = (sizes > 1) & some
    keep = np.repeat(good, sizes)
    fp, run, sizes = fp[keep], np.repeat(np.arange(good.sum()), sizes[good]), sizes[good]
    starts = np.cumsum(sizes) - sizes
    root = np.arange(len(fp))
    small = np.repeat(sizes <= 32, sizes)
    pairs = []
    for lag in range(1, min(32, int(sizes.max(initial=0)))):
        i = np.flatnonzero(small[:-lag] & (run[:-lag] == run[lag:]) & _near(fp[:-lag], fp[lag:]))
        if len(i):
            pairs.append((i, i + lag))
    if pairs:
        a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
        while True:
            before = root.copy()
            np.minimum.at(root, b, root[a])
            np.minimum.at(root, a, root[b])
            root = root[root]
            if (root == before).all():
                break
    for k in np.flatnonzero(sizes > 32):
        at = slice(starts[k], starts[k] + sizes[k])
        root[at] = starts[k] + local_roots(fp[at])
    own = root == np.arange(len(fp))
    return fp[~own], fp[root[~own]]


def near_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct ``fp`` of ``fps`` whose components are those of all links."""
    bounded_batches(fps.sparkSession)
    kind, arrow = schema_of("anchor long, fp long")
    to, edge = schema_of("a long, b long")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        code = Anchors()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 2048):
                part = fp[i : i + 2048]
                row, anchor = code.reach(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], schema=arrow)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        code = Anchors()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told(last: bool) -> Iterator[pa.RecordBatch]:
            anchor, fp = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            end = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
            if end < len(anchor):
                held.append((anchor[end:], fp[end:]))
            if end:
                a, b = _links(anchor[:end], fp[:end], code)
                got = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], 1), axis=0)
                for i in range(0, len(got), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[i : i + 65536, k])) for k in (0, 1)], schema=edge)

        size = 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            size += b.num_rows
            if size >= 500_000:
                yield from told(False)
                size = 0
        if held:
            yield from told(True)

    dealt = fps.select("fp").mapInArrow(spread, kind).repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(meet, to)


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp, component) for every row of ``docs``; component is the least key reachable."""
    each = cut(fingerprints(docs, key=key, text=text, width=width), "fingerprints")
    return _group(each, key).drop("root")


def _group(each: DataFrame, key: str) -> DataFrame:
    """``each`` (key, fp and more) with component and root, the fingerprint that tells the group: ids may be null or repeated."""
    fps = cut(each.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    linked = cut(components(near_links(fps)), "components")
    rooted = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("m")), "least")
    known = cut(split_lookup(rooted, least, "root", "m").select("fp", "n", "component", "root"), "known")
    return split_lookup(each, known, "fp", "n")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 1, distinct: bool = True) -> DataFrame:
    """The rows of ``docs`` with the least key of each group of linked fingerprints, one row a group.

    By default fingerprints are those of the distinct words: an edit changes
    one of these where it changes several shingles, so near copies come within
    the threshold far more often. ``docs`` is read twice and has to give the
    same rows both times.

    A null key comes last. Of rows of a group that share that key and differ,
    the one with the least hash of all columns stays; of equal rows one stays.
    Rows whose fingerprints don't link never replace each other, whatever their
    keys.
    """
    names = docs.columns
    row, n = free_name(docs, "fp_row"), free_name(docs, "fp_n")
    told = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    tagged = docs.withColumn(row, F.xxhash64(*told))
    kind = docs.schema[key].dataType.simpleString()

    def make():
        return lambda b: {"key": b.column(0), "row": b.column(2), "fp": np.array([fingerprint(t, width, distinct) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)}

    each = cut(map_batches(tagged.select(key, text, row), make, f"key {kind}, row long, fp long"), "fingerprints")
    got = _group(each, "key")
    chosen = got.groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("s")).select(F.col("s.row").alias(row))
    counted = cut(chosen.join(each.select(F.col("row").alias(row)), row).groupBy(row).agg(F.count(F.lit(1)).alias(n)), "chosen")
    stay = tagged.join(counted.hint("merge"), row, "inner")  # the same plan at every size
    every = [F.col(f"`{c}`") for c in names]
    once = stay.filter(F.col(n) == 1).select(*every)
    more = stay.filter(F.col(n) > 1).dropDuplicates([row]).select(*every)
    return once.unionByName(more)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = groups(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
