"""Texts as blocks of codes, and the n-grams that a block asks about.

Documents are packed into blocks of a bounded number of tokens. A block asks
once for each of its distinct n-grams, with its own count, through the tree of
:mod:`.exchange`; no vocabulary or count table is broadcast or collected, and
all state is bounded by the size of a block or of a node.

Hashes stand for words and n-grams, their lowest two bits telling the order;
with 62 bits left a collision changes a count of about one n-gram in a billion
at a billion distinct n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import bounded_batches, lean, schema_of
from .exchange import MESSAGE, Sums, Tree, expand, messages, mix, rows_to_batches, squeeze

BLOCK_TOKENS = 1_000_000
NODE_KEYS = 750_000
#: Codes of the start and the end of a text; words follow.
BOS, END = 0, 1
HASH_OF = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
ORDERS = 4


class Block:
    """Texts as codes into a local vocabulary; every text ends with END."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, vocab: np.ndarray):
        self.codes, self.sizes, self.vocab = codes, sizes, vocab
        self.starts = np.cumsum(sizes) - sizes

    def keys(self, order: int) -> Iterator[np.ndarray]:
        """Hashes of the n-gram that ends at each token, for orders 2 to ``order``."""
        last = self.vocab[self.codes]
        now, start = last, np.uint64(HASH_OF[BOS])
        for _ in range(order - 1):
            context = np.empty_like(last)
            context[1:] = now[:-1]
            context[self.starts] = start
            start = mix(np.array([start]), np.array([HASH_OF[BOS]], np.uint64))[0]
            now = mix(context, last)
            yield now


def tagged(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys of one order, told apart from those of others by their lowest bits."""
    return keys & ~np.uint64(ORDERS - 1) | np.uint64(order - 1)


def make_blocks(docs: DataFrame, *, text: str, train: str, keep: list[str], block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, n_train, codes, vocab, sizes, train, keep as arrays): texts as words between ASCII white space, A-Z lowered, then one end."""
    bounded_batches(docs.sparkSession)
    extra = ", ".join(f"`{c}` array<{docs.schema[c].dataType.simpleString()}>" for c in keep)
    kind, arrow = schema_of(f"n_train long, n_tokens long, codes binary, vocab binary, sizes binary, train array<boolean>, {extra}")
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()

        def fresh():
            return {}, [], [], [], [[] for _ in keep]

        words, codes, sizes, flags, kept = fresh()
        held = 0

        def done() -> pa.RecordBatch:
            flat, n = np.concatenate(codes), np.array(sizes, np.int32)
            hashes = np.array([*HASH_OF, *map(digest, words)], np.uint64)
            trained = int(n[np.array(flags, bool)].sum())
            cells = [trained, len(flat), squeeze(flat), hashes.tobytes(), squeeze(n), flags, *kept]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

        for b in batches:
            rest = [b.column(2 + i).to_pylist() for i in range(len(keep))]
            for i, (t, flag) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                got = t.encode("utf-8", "surrogatepass").lower().split() if t else []
                if held and held + len(got) >= block_tokens:
                    yield done()
                    words, codes, sizes, flags, kept = fresh()
                    held = 0
                new = words.setdefault
                c = np.array([new(w, len(words) + 2) for w in got] + [END], np.int32)
                codes.append(c)
                sizes.append(len(c))
                flags.append(bool(flag))
                for k, values in zip(kept, rest, strict=True):
                    k.append(values[i])
                held += len(c)
        if sizes:
            yield done()

    return docs.select(text, train, *keep).mapInArrow(run, kind).withColumn("block", F.monotonically_increasing_id())


def read_block(row: dict) -> Block:
    return Block(expand(row["codes"], "i4"), expand(row["sizes"], "i4").astype(np.int64), np.frombuffer(row["vocab"], np.uint64))


def asked(block: Block, order: int, flags: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(sorted distinct keys of all orders, their places, trained counts).

    The first places are those of the vocabulary's words, the others those of
    each token's n-gram by order.
    """
    trained = np.repeat(flags, block.sizes)
    keys, places, counts = [], [], []
    for k, each in enumerate([block.vocab, *block.keys(order)], 1):
        distinct, where = np.unique(tagged(each, k), return_inverse=True)
        tokens = where[block.codes] if k == 1 else where
        keys.append(distinct)
        places.append(where + sum(map(len, keys[:-1])))
        counts.append(np.bincount(tokens[trained], minlength=len(distinct)))
    flat = np.concatenate(keys)
    by = np.argsort(flat, kind="stable")
    to = np.empty(len(by), np.int64)
    to[by] = np.arange(len(by))
    return flat[by], [to[p] for p in places], np.concatenate(counts)[by]


def ask(blocks: DataFrame, order: int, tree: Tree) -> DataFrame:
    """Each block's n-grams with their counts there, to the first level of the tree."""
    kind, arrow = schema_of(MESSAGE)
    sums = Sums()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for row in b.to_pylist():
                keys, _, counts = asked(read_block(row), order, np.array(row["train"], bool))
                yield from messages(row["block"], keys, (counts,), sums, tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from rows_to_batches(rows(batches), arrow)

    return blocks.mapInArrow(run, kind)
