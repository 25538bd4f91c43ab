"""Language-model scores by deleted interpolation.

The probability of a word mixes the maximum-likelihood estimates of all orders
and a uniform share, with weights that depend on how often the context was
seen in training (buckets by powers of two). The weights are learned by
expectation-maximisation on held-out counts: every trained token in turn is
left out of the counts and predicted from the rest. That evidence is gathered
over all trained tokens as a histogram whose cells are the bucket and the
ratios of the estimates in octaves, with their mean logarithms, so it has a
bounded number of rows; the scores themselves use the exact counts.

Counts are gathered and looked up as in :mod:`.ngram_shards`, whose words are
those between ASCII white space, A-Z lowered.

Defined results: a null or empty text is its end token alone; an unseen word
gets the uniform share; with no trained text every weight is on that share;
repeated rows are each counted and scored; a null id has the remainder of the
empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import ngram_shards as S
from .arrow_map import lean, schema_of
from .session import cut, drop_tables, read_table

BUCKETS = 48
#: Ratios to the uniform share are told apart by octaves; a third of the STEPS are below one.
STEPS = 60
ORDER = 2


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the position of its count's highest bit."""
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0)


def estimates(grams: list[np.ndarray], contexts: list[np.ndarray], left_out: int = 0) -> list[np.ndarray]:
    """Maximum-likelihood estimates per order; ``left_out`` occurrences of the token itself don't count."""
    return [np.maximum(g - left_out, 0) / np.maximum(c - left_out, 1) for g, c in zip(grams, contexts, strict=True)]


def step(logs: np.ndarray) -> np.ndarray:
    """The octave of a ratio from its logarithm, 0 for a ratio of zero."""
    return np.where(np.isneginf(logs), 0, 1 + np.clip(np.rint(np.where(np.isneginf(logs), 0, logs)) + STEPS // 3, 0, STEPS - 1)).astype(np.int64)


def learn(buckets: np.ndarray, ratios: np.ndarray, counts: np.ndarray, order: int, rounds: int = 200, tiny: float = 1e-6) -> np.ndarray:
    """Weights (BUCKETS, order + 1), uniform share last, by expectation-maximisation over the histogram.

    ``ratios`` are the estimates of each order by the uniform share. A bucket
    without evidence takes the weights of the nearest one below it, or those
    of all evidence.
    """

    def fit(some: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = np.concatenate([some, np.ones((len(n), 1))], axis=1)
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            share = p * w
            new = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            new = np.maximum(new, 1e-9)
            new /= new.sum()
            moved = np.abs(new - w).max()
            w = new
            if moved < tiny:
                break
        return w

    out = np.zeros((BUCKETS, order + 1))
    out[:, -1] = 1
    if not len(counts):
        return out
    last = fit(ratios, counts)
    for b in range(BUCKETS):
        at = buckets == b
        if counts[at].sum() > 0:
            last = fit(ratios[at], counts[at])
        out[b] = last
    return out


def looked_up(blocks: DataFrame, replies: DataFrame, order: int, many: int, keep: list[str]) -> DataFrame:
    """Blocks with the total counts of every token's n-grams, in training."""
    extra = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in keep)
    kind, arrow = schema_of(f"sizes binary, train array<boolean>, codes binary, words binary, grams array<binary>, {extra}")
    sums = X.Sums()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        rows = left.to_pylist()
        if not rows:
            return pa.Table.from_batches([], schema=arrow)
        row = rows[0]
        _, places, _ = S.asked(S.read_block(row), order, np.array(row["train"], bool))
        (totals,) = X.whole(right, sums)
        grams = [X.small(totals[p]) for p in places[1:]]
        cells = [row["sizes"], row["train"], row["codes"], X.squeeze(totals[places[0]]), grams, *[row[c] for c in keep]]
        return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

    left, right = X.with_replies(blocks, replies, many)
    return left.cogroup(right).applyInArrow(meet, kind)


def token_counts(row: dict, order: int, n_train: int, n_docs: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per token: counts of its n-grams and of their contexts by order, and the sizes of the texts."""
    sizes = X.expand(row["sizes"], "i4").astype(np.int64)
    codes, words = X.expand(row["codes"], "i4"), X.expand(row["words"], "i8")
    grams = [words[codes], *[X.large(b) for b in row["grams"]]]
    starts = np.cumsum(sizes) - sizes
    contexts = [np.full(len(codes), n_train)]
    for g in grams[: order - 1]:
        c = np.empty_like(g)
        c[1:] = g[:-1]
        c[starts] = n_docs  # only starts of texts follow the start
        contexts.append(c)
    return grams, contexts, sizes


def evidence(looked: DataFrame, order: int, n_train: int, n_docs: int, kinds: int) -> DataFrame:
    """The histogram of held-out estimates over all trained tokens: cell, n and the summed logarithms r1, r2, ... of the ratios."""
    sums = [f"r{k}" for k in range(1, order + 1)]
    kind, arrow = schema_of("cell long, n long, " + ", ".join(f"{c} double" for c in sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for row in b.to_pylist():
                grams, contexts, sizes = token_counts(row, order, n_train, n_docs)
                trained = np.repeat(np.array(row["train"], bool), sizes)
                cell = bucket(contexts[-1][trained] - 1)
                logs = []
                for p in estimates([g[trained] for g in grams], [c[trained] for c in contexts], 1):
                    with np.errstate(divide="ignore"):
                        logs.append(np.log2(p * (kinds + 1)))
                    cell = cell * (STEPS + 1) + step(logs[-1])
                cells, where, n = np.unique(cell, return_inverse=True, return_counts=True)
                total = [np.bincount(where, np.where(np.isneginf(x), 0, x), len(cells)) for x in logs]
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n), *map(pa.array, total)], schema=arrow)

    return looked.mapInArrow(run, kind).groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])


def histogram(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, mean ratios by order, counts) of collected evidence."""
    cell, n = table.column("cell").to_numpy(), table.column("n").to_numpy().astype(float)
    ratios = np.zeros((len(cell), order))
    for k in range(order, 0, -1):
        ratios[:, k - 1] = np.where(cell % (STEPS + 1) > 0, 2.0 ** (table.column(f"r{k}").to_numpy() / np.maximum(n, 1)), 0.0)
        cell = cell // (STEPS + 1)
    return cell, ratios, n


def score_texts(docs: DataFrame, train: str, *, keep: list[str], text: str = "text", order: int = ORDER, block_tokens: int = S.BLOCK_TOKENS, fan: int = X.FAN) -> DataFrame:
    """keep, train, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    blocks = cut(S.make_blocks(docs, text=text, train=train, keep=keep, block_tokens=block_tokens), "blocks")
    n_train, n_all, many, n_docs = blocks.agg(X.total("n_train"), X.total("n_tokens"), F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0))).first()
    tree = X.plan(many, order * n_all, S.NODE_KEYS, fan)
    replies, kinds = X.gather(S.ask(blocks, order, tree), X.Sums(), tree, "ngrams")
    looked = cut(looked_up(blocks, replies, order, many, keep), "looked")
    drop_tables(docs.sparkSession, blocks, replies)
    weights = learn(*histogram(evidence(looked, order, n_train, n_docs, kinds).toArrow(), order), order)
    extra = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    kind, arrow = schema_of(f"{extra}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for row in b.to_pylist():
                grams, contexts, sizes = token_counts(row, order, n_train, n_docs)
                w = weights[bucket(contexts[-1])]
                p = w[:, -1] / (kinds + 1)
                for k, e in enumerate(estimates(grams, contexts)):
                    p = p + w[:, k] * e
                starts = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                base = np.log10((grams[0] + 0.5) / (n_train + 0.5 * (kinds + 1)))
                cells = [*[row[c] for c in keep], row["train"], sizes, add((grams[0] > 0).astype(np.int64)), np.full(len(sizes), n_train), add(base), add(np.log10(p))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

    return looked.mapInArrow(run, kind)


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1).alias("op1_train"))
    got = score_texts(docs, "op1_train", keep=["doc_id"])
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
