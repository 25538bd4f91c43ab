"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in Spark expression: no user functions, no shuffle, one
pass over the text. A rule names a metric, a lower and an upper bound; the
table may be replaced by the caller. A rule may bind some languages only: the
stop-word bound says nothing about a text in a language without a list.

Defined results: a null text counts as empty (no words); an empty text has
zero for every count and is rejected by the base rule; null bounds do not
bind; a null or empty language, or none at all, binds like a listed one, and
of a tag such as ``en-GB`` the part before the hyphen counts, in either case;
ratios over zero words or lines are zero; repeated rows are judged
alike; other columns are ignored or, in :func:`keep_good`, passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read_table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = {
    "en": "the be to of and that have with for are was is in on it this by or",
    "fr": "le la les de des et un une est que qui dans pour en du au",
    "de": "der die das und ist ein eine den von zu mit auf für nicht sich",
    "es": "el los las una por con para del se no es como su al lo",
}
LISTED = sorted({w for words in STOP_WORDS.values() for w in words.split()})


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose ``metric`` is under ``least`` or over ``most``, of ``langs`` only if given."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    langs: tuple[str, ...] | None = None


#: Thresholds in the spirit of published web-corpus filters.
RULES = (
    Rule("mean_word_chars", "mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", "symbol_ratio", None, 0.3),
    Rule("repeated_words", "repeat_ratio", None, 0.4),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("capitals", "capital_ratio", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.01, None, tuple(STOP_WORDS)),
    Rule("bullet_lines", "bullet_ratio", None, 0.9),
    Rule("cut_lines", "ellipsis_ratio", None, 0.3),
)


def _clear(df: DataFrame, names: list[str]) -> str:
    """A prefix under which none of ``names`` clashes with a column of ``df``."""
    prefix = "q_"
    while any((prefix + n).lower() == c.lower() for n in names for c in df.columns):
        prefix += "_"
    return prefix


def metrics(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with helper columns, and the metrics as expressions over them."""
    names = ["t", "w", "l", "s", "p"]
    q = _clear(df, names)
    c = {n: F.col(q + n) for n in names}
    got = df.withColumn(q + "t", F.coalesce(F.col(text), F.lit("")))
    got = got.withColumns(
        {
            q + "w": F.filter(F.split(c["t"], SPACE), lambda w: w != ""),
            q + "l": F.filter(F.split(c["t"], "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    window = lambda i: F.struct(F.xxhash64(F.get(c["w"], i), F.get(c["w"], i + 1), F.get(c["w"], i + 2)).alias("h"), i.alias("i"))
    some = F.when(F.size(c["w"]) >= 3, F.sequence(F.lit(0), F.size(c["w"]) - 3)).otherwise(F.array().cast("array<int>"))
    got = got.withColumn(q + "s", F.sort_array(F.transform(some, window)))

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(c["s"], i - 1)["h"], F.get(c["s"], i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    found = F.filter(c["s"], twice)
    got = got.withColumn(q + "p", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.transform(c["p"], lambda x, i: F.least(F.lit(3), F.coalesce(F.get(c["p"], i + 1) - x, F.lit(3))))
    count = lambda a: F.size(a).cast("long")
    total = F.length(c["t"])
    m = {
        "n_words": count(c["w"]),
        "word_chars": F.length(F.regexp_replace(c["t"], SPACE, "")).cast("long"),
        "n_symbols": (total - F.length(F.translate(c["t"], SYMBOLS, ""))).cast("long"),
        "n_lines": count(c["l"]),
        "n_dup_lines": count(c["l"]) - count(F.array_distinct(c["l"])),
        "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")),
        "n_capitals": F.length(F.regexp_replace(c["t"], r"[^\p{Lu}]+", "")).cast("long"),
        "n_stop_words": count(F.filter(c["w"], lambda w: F.lower(w).isin(LISTED))),
        "n_bullets": count(F.filter(c["l"], lambda x: x.rlike(r"^\s*[-*•‣◦]"))),
        "n_ellipses": count(F.filter(c["l"], lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    }
    return got, m


def measured(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` and a struct column of the metrics, and that column's name.

    The struct passes through a generator of one row, which a later filter
    isn't pushed below: each metric is computed once, not once per mention.
    """
    names = df.columns
    got, m = metrics(df, text)
    q = _clear(got, ["m"]) + "m"
    one = F.explode(F.array(F.struct(*[v.alias(k) for k, v in m.items()])))
    return got.select(*[F.col(f"`{n}`") for n in names], one.alias(q)), q


def language(df: DataFrame, lang: str | None) -> Column:
    """The language of each row, lower-cased and without its region; empty if it isn't told."""
    if lang is None or lang.lower() not in [c.lower() for c in df.columns]:
        return F.lit("")
    return F.coalesce(F.lower(F.element_at(F.split(F.col(f"`{lang}`").cast("string"), "[-_]"), 1)), F.lit(""))


def verdict(q: str, rules: tuple[Rule, ...], tongue: Column) -> tuple[Column, Column, Column]:
    """(base_failed, kept, names of the failed rules) over the struct ``q`` and the rows' language."""
    r = lambda k: F.col(q)[k]
    over = lambda a, b: F.when(r(b) > 0, r(a) / r(b)).otherwise(F.lit(0.0))
    ratios = {
        "mean_word_chars": ("word_chars", "n_words"),
        "symbol_ratio": ("n_symbols", "n_words"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "capital_ratio": ("n_capitals", "word_chars"),
        "stop_word_ratio": ("n_stop_words", "n_words"),
        "bullet_ratio": ("n_bullets", "n_lines"),
        "ellipsis_ratio": ("n_ellipses", "n_lines"),
    }
    base = (r("n_words") < 50) | (100 * r("n_repeat_words") > 50 * r("n_words"))
    each = []
    for x in rules:
        v = over(*ratios[x.metric]) if x.metric in ratios else r(x.metric)
        low = F.lit(False) if x.least is None else v < F.lit(x.least)
        high = F.lit(False) if x.most is None else v > F.lit(x.most)
        binds = F.lit(True) if x.langs is None else tongue.isin("", *x.langs)
        each.append((x.name, (low | high) & binds))
    kept = ~base
    for _, bad in each:
        kept = kept & ~bad
    return base, kept, F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in each])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """One row per row of ``docs``: key, the counts, base_failed, kept, failed_rules."""
    own = _clear(docs, ["g"]) + "g"
    got, q = measured(docs.select(F.col(key), F.col(text), language(docs, lang).alias(own)), text)
    base, kept, failed = verdict(q, rules, F.col(own))
    return got.select(F.col(key), F.col(f"{q}.*"), base.alias("base_failed"), kept.alias("kept"), failed.alias("failed_rules"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    got, q = measured(docs, text)
    return got.filter(verdict(q, rules, language(docs, lang))[1]).select(*[F.col(f"`{n}`") for n in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_capitals", "n_stop_words", "failed_rules",
    )


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The query's rows in DuckDB's SQL; windows by self-counting instead of sorted hashes."""
    ratios = {
        "mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "repeat_ratio": ("n_repeat_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "capital_ratio": ("n_capitals", "word_chars"), "stop_word_ratio": ("n_stop_words", "n_words"), "bullet_ratio": ("n_bullets", "n_lines"), "ellipsis_ratio": ("n_ellipses", "n_lines"),
    }
    failed = []
    for x in rules:
        a, b = ratios[x.metric]
        value = f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"
        sides = [f"{value} < {x.least}"] * (x.least is not None) + [f"{value} > {x.most}"] * (x.most is not None)
        binds = "" if x.langs is None else f" AND tongue IN ('', {', '.join(map(repr, x.langs))})"
        failed.append(f"CASE WHEN ({' OR '.join(sides)}){binds} THEN '{x.name}' END")
    blank = r"[\x20\x09-\x0D]"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, coalesce(lower(regexp_extract(lang, '^[^-_]*')), '') AS tongue FROM documents),
    w AS (SELECT row, doc_id, tongue, t, [x FOR x IN string_split_regex(t, '{blank}+') IF x <> ''] AS w,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM d),
    g AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    r AS (SELECT row, count(DISTINCT k) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY row),
    m AS (SELECT doc_id, tongue, len(w) AS n_words, length(regexp_replace(t, '{blank}+', '', 'g')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_capitals,
        len([x FOR x IN w IF lower(x) IN ({", ".join(f"'{x}'" for x in LISTED)})]) AS n_stop_words, len([x FOR x IN l IF regexp_matches(x, '^{blank}*[-*•‣◦]')]) AS n_bullets,
        len([x FOR x IN l IF regexp_matches(x, '(\\.\\.\\.|…){blank}*$')]) AS n_ellipses FROM w LEFT JOIN r USING (row)),
    v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {", ".join(failed)}) AS failed_rules FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, n_lines, n_capitals, n_stop_words, failed_rules FROM v
    """


#: op10_quality_rules in DuckDB's SQL.
SQL = _sql()
