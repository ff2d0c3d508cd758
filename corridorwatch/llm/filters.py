"""How document filters interact, counted on sorted posting lists.

Every document gets a row number; the numbers of the rows that fail a filter, kept per
part (source) and filter, are its posting lists, cut into ranges of ``RANGE`` numbers. For
each part and range the lists of the five filters are merged: the union of every set of
filters comes from a smaller union and one more list, by galloping the shorter list through
the longer one. The sizes of the 32 unions (all rows, good rows, toxic rows) add up over
the ranges. Every figure of the audit is a difference of union sizes, so all orders
of the filters follow from 32 sums per part, and no order is ever run over the rows.

Filters (words are ``common.WORD``): A under 200 words; B 100 * distinct words < 50 * words;
C 100 * ``[A-Z]`` characters > 2 * code points; D holds one of ``#$%&*|``; E equals the text
of a smaller doc_id.

Defined results: a null text is the empty text (it fails A, and E like any other text); a
null source is the part ``''``, together with a source that is the empty string; a null
doc_id is smaller than none and has no smaller one, so such rows never fail E nor make
others fail it; rows that repeat an id count each and don't fail E through each other; a
row is good or toxic if any label row of its id says so, null ids never are; an empty table
gives no rows; texts are read whole whatever their length; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch.llm.common import WORD, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Row numbers that one posting list covers at most.
RANGE = 1 << 15
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, part, a .. e, good, toxic) for every row; row numbers are unique and stay as written."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(whole) - F.length(F.translate(whole, _UPPER, ""))
    rows = docs.select(
        F.col(key).cast("bigint").alias("id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
        F.md5(whole.cast("binary")).alias("digest"),
        F.regexp_count(whole, F.lit(WORD)).alias("n"),
        F.size(F.array_distinct(words)).alias("distinct"),
        (F.lit(100) * capitals > F.lit(2) * F.length(whole)).alias("c"),
        whole.rlike(r"[#$%&*|]").alias("d"),
    ).select(
        F.monotonically_increasing_id().alias("row"), "id", "part", "digest",
        (F.col("n") < 200).alias("a"),
        (F.col("distinct").cast("bigint") * 100 < F.col("n").cast("bigint") * 50).alias("b"),
        "c", "d",
    )
    rows = written(rows, "audit-rows")
    # texts under several ids, written first: the join then meets plain exchanges, and a hot text can be split
    shared = rows.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    shared = written(shared.where(F.col("least") < F.col("most")).select("digest", "least"), "audit-shared")
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marks = written(marks.where(F.col("id").isNotNull() & ((F.col("good") == 1) | (F.col("toxic") == 1))), "audit-labels")
    return (
        rows.join(shared, "digest", "left")
        .join(marks, "id", "left")
        .select(
            "row", "part", "a", "b", "c", "d",
            F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("e"),
            F.coalesce(F.col("good") == 1, F.lit(False)).alias("good"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
        )
    )


def posting_lists(failed: DataFrame) -> DataFrame:
    """(part, good, toxic, n, a .. e): per part, label class and range of rows, the sorted row numbers that fail each filter.

    A hot part is cut by the ranges, which hold at most ``RANGE`` rows of all parts together.
    Rows that fail nothing are counted, not listed.
    """
    lists = [F.sort_array(F.collect_list(F.when(F.col(f), F.col("row")))).alias(f) for f in FILTERS.lower()]
    return failed.groupBy("part", F.floor(F.col("row") / RANGE).alias("range"), "good", "toxic").agg(F.count("*").alias("n"), *lists)


def _gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which elements of a sorted list are in another: each is sought by halving steps behind the one before."""
    if not len(long):
        return np.zeros(len(short), dtype=bool)
    at = np.searchsorted(long, short)
    return long[np.minimum(at, len(long) - 1)] == short


def union(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sorted union of two sorted lists without repeats."""
    long, short = (left, right) if len(left) >= len(right) else (right, left)
    if not len(short):
        return long
    new = short[~_gallop(short, long)]
    return np.insert(long, np.searchsorted(long, new), new) if len(new) else long


def union_sizes(lists: list[np.ndarray]) -> list[int]:
    """The size of the union for every set of lists; list i stands for the bit 1 << i."""
    merged: list[np.ndarray] = [np.empty(0, dtype=np.int64)]
    for mask in range(1, 1 << len(lists)):
        top = mask.bit_length() - 1
        merged.append(union(merged[mask ^ (1 << top)], lists[top]))
    return [len(m) for m in merged]


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [batch.column(batch.schema.get_field_index(f)) for f in FILTERS.lower()]
        ends = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in lists]
        sizes = [union_sizes([values[at[i] : at[i + 1]] for at, values in ends]) for i in range(batch.num_rows)]
        columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("part", "good", "toxic", "n")}
        yield pa.RecordBatch.from_pydict({**columns, "sizes": pa.array(sizes, type=pa.list_(pa.int64()))})


def part_sizes(lists: DataFrame) -> DataFrame:
    """part, n and union sizes ``all``, ``good``, ``toxic`` (arrays by filter set), one row per part."""
    merged = lists.select("part", "good", "toxic", "n", *FILTERS.lower()).mapInArrow(
        _merge_lists, "part string, good boolean, toxic boolean, n bigint, sizes array<bigint>"
    )

    def totals(of, name):
        return F.array(*[F.sum(F.when(of, F.col("sizes")[m]).otherwise(0)) for m in range(MASKS)]).alias(name)

    every = F.lit(True)
    return merged.groupBy("part").agg(F.sum("n").alias("n"), totals(every, "all"), totals(F.col("good"), "good"), totals(F.col("toxic"), "toxic"))


def _orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, set before, filter bit) for all orders."""
    found = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            found.append(("".join(order), step, before, bit))
            before |= bit
    return found


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sizes = part_sizes(posting_lists(failures(docs, labels, key, text, source)))
    sizes = written(sizes, "audit-sizes")
    orders = _orders()
    step = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(m).alias("m"), F.lit(b).alias("b")) for o, s, m, b in orders]))
    at = sizes.withColumn("s", step).select("*", "s.filter_order", "s.step", "s.m", "s.b")

    def grown(name, before, bit):
        return F.col(name)[before.bitwiseOR(bit)] - F.col(name)[before]

    m, b = F.col("m"), F.col("b")
    removed = grown("all", m, b)
    # an order's removed at any step, summed over all orders: each set before the filter as often as orders have it
    share = F.lit(0).cast("bigint")
    for name in FILTERS:
        bit = 1 << FILTERS.index(name)
        weight: dict[int, int] = {}
        for _, _, before, own in orders:
            if own == bit:
                weight[before] = weight.get(before, 0) + 1
        share = F.when(b == bit, sum((F.lit(w) * grown("all", F.lit(s), F.lit(bit)) for s, w in weight.items()), F.lit(0))).otherwise(share)
    everything = MASKS - 1
    return at.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.col("all")[m.bitwiseOR(b)]).alias("kept"),
        removed.alias("removed"),
        (F.col("all")[b] - removed).alias("redundant"),
        (F.col("all")[everything] - F.col("all")[F.lit(everything) - b]).alias("unique_fails"),
        grown("good", m, b).alias("good_lost"),
        grown("toxic", m, b).alias("toxic_lost"),
        share.alias("shapley"),
    )


#: The audit step by step: each order is applied to the count of rows per part and set of failed filters.
SQL = r"""
WITH worded AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), firsts AS (
    SELECT t, min(doc_id) AS least FROM worded GROUP BY t
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1
), failed AS (
    SELECT w.part,
           len(words) < 200 AS "A",
           100 * len(list_distinct(words)) < 50 * len(words) AS "B",
           100 * len(regexp_extract_all(w.t, '[A-Z]')) > 2 * length(w.t) AS "C",
           regexp_matches(w.t, '[#$%&*|]') AS "D",
           coalesce(w.doc_id > f.least, false) AS "E",
           w.doc_id IN (SELECT doc_id FROM good) AS good,
           w.doc_id IN (SELECT doc_id FROM toxic) AS toxic
    FROM worded w LEFT JOIN firsts f ON f.t = w.t
), patterns AS (
    SELECT part, (CASE WHEN "A" THEN 'A' ELSE '' END) || (CASE WHEN "B" THEN 'B' ELSE '' END) || (CASE WHEN "C" THEN 'C' ELSE '' END)
           || (CASE WHEN "D" THEN 'D' ELSE '' END) || (CASE WHEN "E" THEN 'E' ELSE '' END) AS fails,
           count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
    FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, s::INT AS step, substr(filter_order, s::INT, 1) AS f, left(filter_order, s::INT - 1) AS before
    FROM orders, range(1, 6) t(s)
), counted AS (
    SELECT p.part, s.filter_order, s.step, s.f,
           sum(n) FILTER (WHERE NOT contains(fails, f) AND NOT regexp_matches(fails, '[' || before || '0]')) AS kept,
           sum(n) FILTER (WHERE contains(fails, f) AND NOT regexp_matches(fails, '[' || before || '0]')) AS removed,
           sum(n) FILTER (WHERE contains(fails, f) AND regexp_matches(fails, '[' || before || '0]')) AS redundant,
           sum(n) FILTER (WHERE fails = f) AS unique_fails,
           sum(n_good) FILTER (WHERE contains(fails, f) AND NOT regexp_matches(fails, '[' || before || '0]')) AS good_lost,
           sum(n_toxic) FILTER (WHERE contains(fails, f) AND NOT regexp_matches(fails, '[' || before || '0]')) AS toxic_lost
    FROM patterns p, steps s GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM counted
"""
