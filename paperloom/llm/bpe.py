"""Byte-pair encoding with forced boundaries, and decoding.

A pair of bytes that occurs inside no vocabulary token can never end up
inside one token, so the text may be cut there: fragments between such cuts
are encoded independently and their ids concatenated. Before that the text is
cut where the vocabulary's own pre-tokeniser cuts. Encoded units are kept in a
dictionary that is emptied when it reaches a fixed number of bytes.

Defined results: a null or empty text has no ids; an id sequence that isn't
valid UTF-8 decodes with replacement characters; repeated rows give repeated
results; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .arrow_map import map_batches
from .kept import Kept
from .session import read_table

# White space of the pre-tokeniser: Python's \s without the four separators that only Python counts.
UNIT = re.compile(r"(?: ?(?:\S|[\x1c-\x1f])+)|[^\S\x1c-\x1f]+(?!\S|[\x1c-\x1f])|[^\S\x1c-\x1f]")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Byte-level BPE from a tokenizers file whose ids follow its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            for a, b in zip(token, token[1:], strict=False):
                self.inside[a, b] = True
        self.cut = {bytes((a, b)) for a in range(256) for b in range(256) if not self.inside[a, b]}
        self.core = tiktoken.Encoding("units", pat_str="", mergeable_ranks=vocab, special_tokens={})._core_bpe
        self.text_of = {str(i): t for t, i in vocab.items()} | {str(i): s.encode() for s, i in self.special.items()}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.units = Kept(self._unit)
        self.fragments = Kept(lambda b: self.core.encode_single_piece(b), 1 << 20)  # single bytes only

    def fragments_of(self, piece: bytes) -> list[bytes]:
        """``piece`` cut at every forced boundary."""
        at = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] in self.cut]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)] if at else [piece]

    def _unit(self, unit: str) -> str:
        ids = []
        for piece in PIECE.findall(unit):
            for fragment in self.fragments_of(piece.encode()):
                ids += self.core.encode_single_piece(fragment) if len(fragment) > 1 else self.fragments[fragment]
        return ",".join(map(str, ids))

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if self.split is None or not any(s in text for s in self.special):
            return ",".join([self.units[u] for u in UNIT.findall(text)])
        parts = [str(self.special[p]) if p in self.special else ",".join([self.units[u] for u in UNIT.findall(p)]) for p in self.split.split(text) if p]
        return ",".join(parts)

    def decode(self, ids: str) -> str:
        return b"".join(map(self.text_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@functools.lru_cache(maxsize=1)
def byte_pairs(path: str) -> ForcedBoundaryBPE:
    """One for all tasks of a worker."""
    return ForcedBoundaryBPE(path)


def round_trip(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (decimal, comma-joined) and the text decoded from them, as digests."""

    def make():
        bpe = byte_pairs(path)

        def f(b):
            n, ids, back = [], [], []
            for t in b.column(1).to_pylist():
                x = bpe.encode(t or "")
                n.append(x.count(",") + 1 if x else 0)
                ids.append(hashlib.sha256(x.encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(x).encode()).hexdigest())
            return {"key": b.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

        return f

    spec = f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(key, text), make, spec).withColumnRenamed("key", key)


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``ids array<int>`` of every text."""

    def make():
        bpe = byte_pairs(path)
        return lambda b: {"key": b.column(0), "ids": [list(map(int, x.split(","))) if (x := bpe.encode(t or "")) else [] for t in b.column(1).to_pylist()]}

    return map_batches(docs.select(key, text), make, f"key {docs.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(frame: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the text of each id array (null: empty)."""

    def make():
        bpe = byte_pairs(path)
        return lambda b: {"key": b.column(0), "text": [bpe.decode(",".join(map(str, x or []))) for x in b.column(1).to_pylist()]}

    return map_batches(frame.select(key, ids), make, f"key {frame.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
