"""Best-fit packing of documents into sequences of bounded length.

Bulk-synchronous best-fit. A document longer than the capacity is cut into
pieces of the capacity, others stay whole. Lengths and gaps are integers up to
the capacity, so their range sort is a counting sort: a piece's place among
all pieces of its length is its block's offset plus its place in the block,
and pieces of one length (or sequences of one gap) differ in rank only. What
is matched in rounds is therefore the table of lengths against the table of
gaps, both no larger than the capacity however many documents there are: in
each round every piece class sweeps to its successor, the smallest gap that
holds it; a sequence takes one piece a round, conflicts go to the first ranks,
the others sweep on to the next gap or wait; gaps are updated and the round
repeated, larger pieces before those under half their size. When nothing fits,
the largest class opens new sequences. The plan's intervals of ranks are then
sent to the blocks, which place every piece without meeting another.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrow_map import map_batches
from .bpe import byte_letters
from .kept import Kept
from .session import cut, read_table

CAPACITY = 2048
#: A word's last byte as the ASCII ranks have it.
LAST = [bytes([i | 128]) for i in range(128)]
SIMPLE = re.compile("[!-~¡-įı-ſ]+")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordIds:
    """Little-endian 32-bit ids of a text, as the tokenizers library gives them.

    The vocabulary drops white space and has word ends, so chunks between
    ASCII white space are encoded alone and kept. A chunk of letters below
    U+0180 (where NFC changes nothing and lower case goes letter by letter)
    is cut into words here; any other goes to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): c for c, b in letters.items()})
        self.ascii = self._ascii(json.loads(self.library.to_str())["model"]["vocab"], letters)
        self.chunks = Kept(self._chunk)
        self.words = Kept(self._word, 16 << 20)  # parts of chunks; words that are chunks by themselves are kept there

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    @staticmethod
    def _ascii(vocab: dict[str, int], letters: dict[str, int]):
        """The vocabulary's ASCII part as byte ranks; the high bit of a byte stands for the end of a word."""
        ranks = {}
        for token, i in vocab.items():
            body = token.removesuffix("</w>")
            b = bytes(letters[c] for c in body) if all(c in letters for c in body) else b""
            if b and max(b) < 128 and not token.startswith("<|"):
                ranks[b if body == token else b[:-1] + bytes([b[-1] | 128])] = i
        return tiktoken.Encoding("words", pat_str="", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _word(self, word: str) -> bytes:
        if word.isascii():
            return self._plain(word.encode())
        return self._bytes([t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def _plain(self, word: bytes) -> bytes:
        return array("I", self.ascii.encode_single_piece(word[:-1] + LAST[word[-1]])).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters
            low = chunk.lower()
            return self._plain(chunk) if low == chunk else self.chunks[low]
        if chunk[-1] in b".,;:!?" and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1].lower()] + self.words[chr(chunk[-1])]
        text = chunk.decode("utf-8", "surrogatepass")
        simple = SIMPLE.fullmatch(text)
        if simple and text.isalpha():
            low = text.lower()
            return self._word(text) if low == text else self.chunks[low.encode()]
        if simple and text[-1] in ".,;:!?" and text[:-1].isalpha():
            return self.chunks[text[:-1].lower().encode()] + self.words[text[-1]]
        if simple and "<|" not in text:
            return b"".join([self.words[w] for w in PIECE.findall(text.lower())])
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.encode("utf-8", "surrogatepass").split()])


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, nth, block); nth counts the pieces of that length in its block."""

    def make():
        coder = WordIds(path)
        tail = np.array([end], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)

        def f(b):
            out: dict[str, list] = {n: [] for n in ("key", "piece", "start", "length", "ids_crc32", "nth")}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = coder.encode(t) + tail if t else tail
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    for name, v in zip(out, (k, i, at // 4, n, zlib.crc32(part), int(seen[n])), strict=True):
                        out[name].append(v)
                    seen[n] += 1
            return out

        return f

    spec = f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, nth long"
    return map_batches(docs.select(key, text), make, spec).withColumn("block", F.spark_partition_id())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of sequences, their lengths in order) for ``counts`` pieces of each length."""
    left = {p: n for p, n in counts.items() if n}
    gaps: list[int] = []  # sorted, of open groups
    groups: dict[int, list[tuple[int, tuple]]] = {}
    done: list[tuple[int, tuple]] = []

    def put(gap: int, n: int, items: tuple) -> None:
        if gap == 0:
            done.append((n, items))
            return
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((n, items))

    while left:
        largest = max(left)
        band = sorted((p for p in left if 2 * p > largest), reverse=True)
        placed: list[tuple[int, int, tuple]] = []
        for p in band:
            at = bisect_left(gaps, p)
            while at < len(gaps) and left[p]:
                gap, some = gaps[at], groups[gaps[at]]
                while some and left[p]:
                    n, items = some.pop()
                    k = min(n, left[p])
                    left[p] -= k
                    placed.append((gap - p, k, (items, p)))
                    if k < n:
                        some.append((n - k, items))
                if some:
                    break
                del groups[gap], gaps[at]
            if not left[p]:
                del left[p]
        if placed:
            for gap, n, items in placed:
                put(gap, n, items)
            continue
        n = left[largest]
        opened = -(-n // (capacity // largest))
        left[largest] -= opened
        if not left[largest]:
            del left[largest]
        put(capacity - largest, opened, ((), largest))
    out = []
    for n, items in [*done, *((n, items) for g in gaps for n, items in groups[g])]:
        flat = []
        while items:
            items, p = items
            flat.append(p)
        out.append((n, flat[::-1]))
    return out


def intervals(groups: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, first rank, sequence of that rank, offset): each interval of ranks goes to consecutive sequences."""
    rows, used, first = [], {}, 0
    for n, items in groups:
        offset = 0
        for p in items:
            rows.append((p, used.get(p, 0), first, offset))
            used[p] = used.get(p, 0) + n
            offset += p
        first += n
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def place(frame: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``frame`` as from :func:`pieces` and cut, with sequence_id and offset."""
    sizes = frame.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    told = frame.sparkSession.sparkContext.broadcast(intervals(plan(counts, capacity)))
    names = [c for c in frame.columns if c not in ("nth", "block")]
    ranked = frame.join(sizes.select("block", "length", "base").hint("merge"), ["block", "length"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    at = names.index("length")

    def make():
        length, rank, seq, offset = told.value
        keys = (length << 48) + rank

        def f(b):
            r = b.column(len(names)).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, (b.column(at).to_numpy(zero_copy_only=False) << 48) + r, side="right") - 1
            return {n: b.column(k) for k, n in enumerate(names)} | {"sequence_id": seq[i] + r - rank[i], "offset": offset[i]}

        return f

    spec = ", ".join(f"`{n}` {frame.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    return map_batches(ranked, make, spec)


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(cut(pieces(docs, path, capacity=capacity, key=key, text=text), "pieces"), capacity=capacity).withColumnRenamed("key", key)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
