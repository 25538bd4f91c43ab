"""Relational operators of the application, generic over tables and columns.

All are plain DataFrame plans. Order-dependent ones take an explicit order
column, since a shuffle keeps none. Aggregations are written so that Spark
combines before the shuffle; lookups leave the join strategy to the size the
optimizer sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.storage import cut

#: Rows that one task of a join and its grouping takes in the mean, and the number of such parts up to which nothing is dealt.
ROWS_OF_A_PART, SMALL = 500_000, 4


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the first by ``order``. Partial aggregation, no window sort."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row_"))
    return packed.select(*keys, "row_.*").select(*df.columns)


def facet_filter(df: DataFrame, facets: dict[str, Sequence], terms: Sequence[str], search: Column) -> DataFrame:
    """Rows whose columns are among the chosen values (none chosen: all) and whose text has every term."""
    for column, values in facets.items():
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    for term in terms:
        df = df.filter(search.contains(term.lower()))
    return df


def search_text(*columns: str) -> Column:
    """Lower-case text of several columns, for substring search; nulls count as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int = 25) -> DataFrame:
    """Page number ``page`` (from 1) in the given order: a top-k per partition, then one merge."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def preview(column: str, size: int = 280) -> Column:
    """The first ``size`` code points, with an ellipsis if there are more."""
    c = F.col(column)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def facet_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value): the distinct values of several columns in one pass over the rows."""
    each = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(each)).filter("value is not null").distinct()


def member_counts(df: DataFrame, member: str, item: str, available: Column) -> DataFrame:
    """Per member the number of distinct items and of available ones; an item counts once per member."""
    once = df.select(member, item, available.alias("ok")).groupBy(member, item).agg(F.max("ok").alias("ok"))
    return once.groupBy(member).agg(F.count(F.lit(1)).alias("items"), F.count_if("ok").alias("available"))


def in_parts(left: DataFrame, right: DataFrame, on: str, most: int = ROWS_OF_A_PART) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join dealt by its key, in so many parts that none has many rows of ``left``.

    A part is sorted and grouped in one task's memory; by the session's number
    of partitions alone it would grow with the table. Small tables are left
    to the optimizer.
    """
    spark = left.sparkSession
    parts = -(-left.count() // most)
    if parts <= min(int(spark.conf.get("spark.sql.shuffle.partitions")), SMALL):
        return left, right
    return left.repartition(parts, on), right.repartition(parts, on)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_summary(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Per key ``label: n`` joined by `` · ``, most frequent first, then by label; ``none`` where all labels are null."""
    counts = df.groupBy(*keys, label).agg(F.count(label).alias("n"))
    known = F.when(F.col(label).isNotNull(), F.struct((-F.col("n")).alias("m"), F.col(label).alias("l")))
    items = F.transform(F.sort_array(F.collect_list(known)), lambda x: F.concat_ws(": ", x["l"], (-x["m"]).cast("string")))
    text = F.array_join(items, " · ")
    return counts.groupBy(*keys).agg(F.when(text == "", "none").otherwise(text).alias("summary"))


def nice_axis(most: Column) -> tuple[Column, Column]:
    """(step, ceiling) of a chart axis in about four steps of tens."""
    step = F.greatest(F.lit(1), F.ceil(most / 4 / 10) * 10)
    return step, F.ceil(most / step) * step


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_anti")


def matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_semi")


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line)."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def segment_end(df: DataFrame, key: str, order: str, boundary: Column, most: int = 100) -> DataFrame:
    """``segment_end``: the next boundary row, or the last row, or ``most`` rows on."""
    after = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    last = F.max(order).over(Window.partitionBy(key)) + 1
    return df.withColumn("segment_end", F.least(F.coalesce(F.min(F.when(boundary, F.col(order))).over(after), last), F.col(order) + most, last))


def longest_heading(df: DataFrame, key: str, order: str, line: str, pattern: str) -> DataFrame:
    """Rows where up to three joined lines match ``pattern``; the longest form wins."""
    w = Window.partitionBy(key).orderBy(order)
    second, third = F.lead(line, 1).over(w), F.lead(line, 2).over(w)
    forms = df.withColumns({"two_": F.concat(line, F.lit(" "), second), "three_": F.concat(line, F.lit(" "), second, F.lit(" "), third)})
    n = F.when(F.col("three_").rlike(pattern), 3).when(F.col("two_").rlike(pattern), 2).when(F.col(line).rlike(pattern), 1)
    heading = F.when(F.col("n_lines") == 3, F.col("three_")).when(F.col("n_lines") == 2, F.col("two_")).otherwise(F.col(line))
    return forms.withColumn("n_lines", n).filter("n_lines is not null").withColumn("heading", heading).drop("two_", "three_")


def carry_forward(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def first_run(df: DataFrame, key: str, order: str, number: str, start: int = 1) -> DataFrame:
    """Per key the first row where three rows in sequence are numbered ``start``, +1, +2."""
    w = Window.partitionBy(key).orderBy(order)
    hit = (F.col(number) == start) & (F.lead(number, 1).over(w) == start + 1) & (F.lead(number, 2).over(w) == start + 2)
    return df.select(key, order, hit.alias("hit_")).filter("hit_").groupBy(key).agg(F.min(order).alias("first_at"))


def dominant(df: DataFrame, key: str, value: str, weight: str, order: str) -> DataFrame:
    """Per key the value of greatest total weight; ties go to the one seen first, then to the least."""
    sums = df.groupBy(key, value).agg(F.sum(weight).alias("w_"), F.min(order).alias("o_"))
    return sums.groupBy(key).agg(F.min_by(value, F.struct((-F.col("w_")).alias("w_"), "o_", value)).alias(value))


def join_if_unique(left: DataFrame, right: DataFrame, on: str, within: Sequence[str] = ()) -> DataFrame:
    """Inner join on a key that occurs once in ``right`` (within a group); others don't match."""
    keys = [*within, on]
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), *[F.first(c).alias(c) for c in rest]).filter("n_ = 1").drop("n_")
    return left.join(once, keys)


def nearest_other(df: DataFrame, group: str, key: str, at: Column) -> DataFrame:
    """Per row the nearest other row of its group, where one alone is nearest.

    The nearest of a sorted group is a neighbour, so two offsets each way tell
    whether it is alone; no pairs are formed. (key, other, distance)
    """
    w = Window.partitionBy(group).orderBy("at_", key)
    c = df.select(group, key, at.alias("at_"))
    for name, k in (("p1", -1), ("p2", -2), ("n1", 1), ("n2", 2)):
        c = c.withColumn(name, F.lag(F.struct("at_", key), -k).over(w))
    near = F.sort_array(F.filter(F.transform(F.array("p1", "p2", "n1", "n2"), lambda x: F.when(x.isNotNull(), F.struct(F.abs(x["at_"] - F.col("at_")).alias("d"), x[key].alias("k")))), lambda x: x.isNotNull()))
    c = c.withColumn("near_", near).filter((F.size("near_") == 1) | (F.get("near_", F.lit(0))["d"] < F.get("near_", F.lit(1))["d"]))
    return c.select(key, F.get("near_", F.lit(0))["k"].alias("other"), F.get("near_", F.lit(0))["d"].alias("distance"))


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs with equal keys whose ranges overlap: an equi-join with the range as its residue."""
    a, b = left_range
    c, d = right_range
    return left.join(right, list(on)).filter((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))


def drop_prefixes(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values that no longer value of the same key begins with; null keys are one key, null values go.

    In sorted order a value that is a prefix of any longer one is a prefix of
    the next distinct one. Distinct values are dealt by ranges of key and
    value, so a key may hold any share of all rows; each range looks ahead by
    itself, and its last value looks at the first of the next range.
    """
    once = df.select(key, value).filter(F.col(value).isNotNull()).distinct()
    dealt = cut(once.repartitionByRange(key, value).withColumn("part_", F.spark_partition_id()), "ranges")
    both = F.struct(key, value)
    firsts = dealt.groupBy("part_").agg(F.min(both).alias("first_"))  # a row per range
    next_first = firsts.select("part_", F.lead("first_").over(Window.orderBy("part_")).alias("beyond_"))
    ahead = dealt.withColumn("next_", F.lead(both).over(Window.partitionBy("part_").orderBy(key, value)))
    seen = ahead.join(F.broadcast(next_first), "part_").withColumn("next_", F.coalesce("next_", "beyond_"))
    longer = F.col(f"next_.{key}").eqNullSafe(F.col(key)) & F.startswith(F.col(f"next_.{value}"), F.col(value))
    return seen.filter(~F.coalesce(longer, F.lit(False))).select(key, value)


def host_allowed(host: Column, hosts: Sequence[str]) -> Column:
    """The host is one of ``hosts`` or below one of them."""
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (host == h) | host.endswith(f".{h}")
    return hit


def expand_range(first: Column, last: Column, widest: int = 100) -> Column:
    """The numbers of a range; none if it is reversed or too wide."""
    return F.when((last >= first) & (last - first <= widest), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def natural_key(column: str, width: int = 12) -> Column:
    """Sort key that compares digit runs by value."""
    padded = F.regexp_replace(F.col(column), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def closure(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes reached from ``roots`` (node) along ``edges`` (src, dst), breadth first.

    Each round keeps only what the rounds before haven't seen, and is written,
    so a plan never holds more than one round.
    """
    front = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)), "closure")
    seen = front
    for d in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "closure")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def primary_or_fallback(df: DataFrame, group: str, primary: Column, fallback: Column) -> DataFrame:
    """Rows with the primary mark where the group has any, else those with the fallback mark. A null group is none.

    The groups that have a primary row are one flag each, combined before the
    shuffle; only fallback rows are looked up among them, so no group's rows
    need meet.
    """
    first = df.filter(primary)
    have = first.select(F.col(group).alias("group_")).distinct()
    second = df.filter(F.coalesce(fallback, F.lit(False)) & ~F.coalesce(primary, F.lit(False)))
    return first.unionByName(second.join(have, F.col(group) == F.col("group_"), "left_anti"))
