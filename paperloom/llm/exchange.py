"""Keyed values from many blocks brought together and sent back, over a tree.

A block holds sorted distinct 64-bit keys with a value each. It sends them, cut
by ranges of the keys, to the nodes of the first level; a node merges what at
most about ``fan`` blocks send it and passes the merged keys on, cut into finer
ranges, until at the last level one node holds all that any block says of its
range. From there the answers go back the same way: every node keeps what it
was sent, so it can answer each sender in the order it asked.

A level multiplies the blocks that meet by ``fan`` and the ranges by about the
same, so a block or node sends about ``fan`` messages whatever the input: their
number grows with the input and not with its square, and there are as many
levels as the logarithm of the number of blocks demands (one up to ``fan``
blocks). A key that is frequent everywhere costs one entry a block, then one a
node; nothing is broadcast, and a node holds about ``node_keys`` entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import bounded_batches, lean, schema_of
from .session import cut, drop_tables

FAN = 256
#: Bytes of messages sent in one batch.
BATCH = 4 << 20
MESSAGE = "node long, child long, keys binary, vals binary"
REPLY = "child long, part long, answer binary, tally long"


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(b: bytes, dtype: str) -> np.ndarray:
    n, kind = int.from_bytes(b[:8], "little"), np.dtype(dtype)
    if not n:
        return np.zeros(0, kind)
    flat = pa.decompress(b[8:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def pair(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def unpair(x: bytes) -> tuple[bytes, bytes]:
    n = 8 + int.from_bytes(x[:8], "little")
    return x[8:n], x[n:]


def small(a: np.ndarray) -> bytes:
    """Counts, mostly small: a byte each, larger ones apart."""
    big = a >= 255
    return pair(squeeze(np.where(big, 255, a).astype(np.uint8)), a[big].astype("<i8").tobytes())


def large(b: bytes) -> np.ndarray:
    """The counts of :func:`small`."""
    head, rest = unpair(b)
    a = expand(head, "u1").astype(np.int64)
    a[a == 255] = np.frombuffer(rest, "<i8")
    return a


def sorted_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def keys_of(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, "u8"), dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its context and of its last word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def by_range(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """The ranges that hold any of the sorted keys (equal parts of the 64 bits, told by the upper 32), and where."""
    some, starts = np.unique((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), return_index=True)
    for r, a, b in zip(some.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        yield r, slice(a, b)


def rows_to_batches(rows: Iterable[tuple], arrow: pa.Schema, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows put together to batches of about ``most`` bytes."""
    held: list[tuple] = []
    size = 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(arrow)], schema=arrow)
    for row in rows:
        held.append(row)
        size += 64 + sum(len(c) for c in row if isinstance(c, bytes))
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class Values:
    """How the values of one exchange are written, merged and answered; each is a tuple of arrays as long as the keys."""

    def pack(self, v: tuple[np.ndarray, ...]) -> bytes:
        raise NotImplementedError

    def unpack(self, b: bytes) -> tuple[np.ndarray, ...]:
        raise NotImplementedError

    def merge(self, v: tuple[np.ndarray, ...], heads: np.ndarray) -> tuple[np.ndarray, ...]:
        """The values of equal keys, which stand together from each of ``heads`` on, as one."""
        raise NotImplementedError

    def pack_answer(self, v: tuple[np.ndarray, ...]) -> bytes:
        return self.pack(v)

    def unpack_answer(self, b: bytes) -> tuple[np.ndarray, ...]:
        return self.unpack(b)

    def tally(self, keys: np.ndarray, v: tuple[np.ndarray, ...]) -> int:
        """What the last level adds up over all keys."""
        return 0


class Sums(Values):
    """Counts; keys whose lowest two bits are zero are tallied if their sum isn't zero."""

    def pack(self, v):
        return small(v[0])

    def unpack(self, b):
        return (large(b),)

    def merge(self, v, heads):
        return (np.add.reduceat(v[0], heads),)

    def tally(self, keys, v):
        return int(((keys & np.uint64(3) == 0) & (v[0] > 0)).sum())


class Least(Values):
    """(least, more): the least number that has a key, and whether another has it too. Answers tell the least only where another has it."""

    def pack(self, v):
        return pair(squeeze(v[0]), squeeze(v[1]))

    def unpack(self, b):
        a, c = unpair(b)
        return expand(a, "i8"), expand(c, "u1")

    def merge(self, v, heads):
        least = np.minimum.reduceat(v[0], heads)
        return least, (np.maximum.reduceat(v[1], heads) | (np.maximum.reduceat(v[0], heads) > least)).astype("u1")

    def pack_answer(self, v):
        return pair(squeeze(v[1]), squeeze(v[0][v[1] > 0]))

    def unpack_answer(self, b):
        a, c = unpair(b)
        more = expand(a, "u1")
        least = np.zeros(len(more), np.int64)
        least[more > 0] = expand(c, "i8")
        return least, more


@dataclass(frozen=True)
class Tree:
    """``ranges`` of each level; each is a multiple of the one before. Level k has fan**(levels - k) groups of blocks."""

    fan: int
    ranges: tuple[int, ...]

    @property
    def levels(self) -> int:
        return len(self.ranges)

    def groups(self, level: int) -> int:
        return self.fan ** (self.levels - level)

    def nodes(self, level: int) -> int:
        return self.groups(level) * self.ranges[level - 1]

    def node(self, member: int, level: int, part: int) -> int:
        """The node for a range; ``member`` is a block's number dealt out, or a group of the level below."""
        return member % self.groups(level) * self.ranges[level - 1] + part


def plan(blocks: int, units: int, node_keys: int, fan: int = FAN) -> Tree:
    """The tree for so many blocks with so many entries in all."""
    levels = 1
    while fan**levels < blocks:
        levels += 1
    ranges, r = [], 1
    for level in range(1, levels + 1):
        r *= max(1, -(-units // (fan ** (levels - level) * node_keys * r)))
        ranges.append(r)
    return Tree(fan, tuple(ranges))


def dealt(block: int) -> int:
    """A block's number, mixed so that groups get equal shares."""
    return int(mix(np.array([block], np.int64).view(np.uint64), np.zeros(1, np.uint64))[0] >> np.uint64(1))


def messages(block: int, keys: np.ndarray, values: tuple[np.ndarray, ...], kind: Values, tree: Tree) -> Iterator[tuple]:
    """Rows of MESSAGE from one block to the first level."""
    member = dealt(block)
    for part, at in by_range(keys, tree.ranges[0]):
        yield tree.node(member, 1, part), block, sorted_keys(keys[at]), kind.pack(tuple(v[at] for v in values))


def together(df: DataFrame, column: str, many: int) -> DataFrame:
    """Dealt by ``column``, over more partitions than the session's where there are more groups."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, many // 2), column)


class _Merged:
    """What one node was sent: distinct keys, their merged values, and where each message's keys are among them."""

    def __init__(self, table: pa.Table, kind: Values):
        self.rows = table.select(["child", "keys", "vals"]).to_pylist()
        keys = [keys_of(r.pop("keys")) for r in self.rows]
        self.sizes = [len(k) for k in keys]
        flat = np.concatenate(keys)
        del keys
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        heads = np.flatnonzero(new)
        self.keys = flat[heads]
        self.where = np.empty(len(order), np.int64)
        self.where[order] = np.cumsum(new) - 1
        parts = [kind.unpack(r.pop("vals")) for r in self.rows]
        self.values = kind.merge(tuple(np.concatenate([p[i] for p in parts])[order] for i in range(len(parts[0]))), heads)

    def answers(self, values: tuple[np.ndarray, ...], part: int, kind: Values) -> list[tuple]:
        ends = np.cumsum(self.sizes)[:-1]
        return [(r["child"], part, kind.pack_answer(tuple(v[at] for v in values)), 0) for r, at in zip(self.rows, np.split(self.where, ends), strict=True)]


def _table(rows: list[tuple], arrow: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def _passed_on(sent: DataFrame, level: int, kind: Values, tree: Tree) -> DataFrame:
    """MESSAGE rows to the next level."""
    spec, arrow = schema_of(MESSAGE)
    ranges = tree.ranges[level - 1]

    def up(table: pa.Table) -> pa.Table:
        lean()
        node = table.column("node")[0].as_py()
        m = _Merged(table, kind)
        group = node // ranges
        rows = [(tree.node(group, level + 1, part), node, sorted_keys(m.keys[at]), kind.pack(tuple(v[at] for v in m.values))) for part, at in by_range(m.keys, tree.ranges[level])]
        return _table(rows, arrow)

    return together(sent, "node", tree.nodes(level)).groupBy("node").applyInArrow(up, spec)


def _settled(sent: DataFrame, level: int, kind: Values, tree: Tree) -> DataFrame:
    """REPLY rows of the last level, and a row of child -1 with each node's tally."""
    spec, arrow = schema_of(REPLY)
    ranges = tree.ranges[level - 1]

    def top(table: pa.Table) -> pa.Table:
        lean()
        part = table.column("node")[0].as_py() % ranges
        m = _Merged(table, kind)
        return _table([*m.answers(m.values, part, kind), (-1, part, b"", kind.tally(m.keys, m.values))], arrow)

    return together(sent, "node", tree.nodes(level)).groupBy("node").applyInArrow(top, spec)


def _handed_down(sent: DataFrame, told: DataFrame, level: int, kind: Values, tree: Tree) -> DataFrame:
    """REPLY rows of a level from what it was sent and what it was told by the next."""
    spec, arrow = schema_of(REPLY)
    ranges = tree.ranges[level - 1]

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        if not len(left):
            return _table([], arrow)
        part = left.column("node")[0].as_py() % ranges
        return _table(_Merged(left, kind).answers(whole(right, kind), part, kind), arrow)

    n = tree.nodes(level)
    return together(sent, "node", n).groupBy("node").cogroup(together(told, "child", n).groupBy("child")).applyInArrow(down, spec)


def whole(replies: pa.Table, kind: Values) -> tuple[np.ndarray, ...]:
    """The answers to one asker, in the order of its keys."""
    rows = sorted(replies.select(["part", "answer"]).to_pylist(), key=lambda r: r["part"])
    parts = [kind.unpack_answer(r["answer"]) for r in rows]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(len(parts[0])))


def gather(sent: DataFrame, kind: Values, tree: Tree, name: str) -> tuple[DataFrame, int]:
    """(replies to the blocks, the tally over all keys) for messages made by :func:`messages`.

    The replies (REPLY, with child a block's number) are written; a block's
    are put together by :func:`whole`.
    """
    spark = sent.sparkSession
    bounded_batches(spark)
    levels = [sent]
    for level in range(1, tree.levels):
        levels[-1] = cut(levels[-1], f"{name}-sent")  # read again on the way back
        levels.append(_passed_on(levels[-1], level, kind, tree))
    told = cut(_settled(levels[-1], tree.levels, kind, tree), f"{name}-told")
    tally = told.filter("child = -1").agg(F.coalesce(F.sum("tally"), F.lit(0))).first()[0]
    told = told.filter("child <> -1")
    for level in range(tree.levels - 1, 0, -1):
        more = cut(_handed_down(levels[level - 1], told, level, kind, tree), f"{name}-told")
        drop_tables(spark, told, levels[level - 1])
        told = more
    return told, tally


def with_replies(blocks: DataFrame, told: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """Both grouped by block for a cogroup; ``many`` is the number of blocks."""
    left, right = together(blocks, "block", many), together(told.withColumnRenamed("child", "block"), "block", many)
    return left.groupBy("block"), right.groupBy("block")


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))
