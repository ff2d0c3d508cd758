"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every source gets a token target. Among all document rates that meet the targets and stay
at most ``MAX_COPIES``, entropy balancing takes those closest to one copy each: rate =
min(MAX_COPIES, exp(lambda * size / mean size)), one dual variable per source. Newton steps
inside a shrinking bracket find all of them at once. The dual's sums depend on a document
only through its source and size, so each step is one small aggregation over the counts per
(source, size), which hold every document.

Rates become whole copies by rounding running sums along the sizes of a source: the taken
words of a source miss the target by at most about half its longest document, and a few
single copies more or less close most of that gap. Inside a
(source, size) cell the copies go to documents in the order of a hash of their id and text; cells are
cut into hash ranges first, so no task ranks a whole hot cell.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source,
the last one; a source whose sizes are all 0 has target 0; repeated rows count and are
ranked each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridorwatch.llm.common import WORD, ranked, same, written

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
#: The bracket alone needs about 60 halvings; Newton steps end far earlier.
STEPS = 80
TOLERANCE = 1e-10


def source_targets(cells: DataFrame) -> DataFrame:
    """source, source_size, target from (source, size, n); one row per source.

    Targets share the total by weight and stop at MAX_COPIES times the source. With the
    sources in the order of limit / weight, the stopped ones come first, so the common
    level of the others follows from running sums.
    """
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (number % len(WEIGHTS) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * MAX_COPIES
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total, before = F.sum("source_size").over(everything), F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("level", (total - before) / left)
        # the first source that its level leaves below the limit gives the level of all after it
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn("target", F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))))
        .select("source", "source_size", "target")
    )


def _rate(dual: Column) -> Column:
    return F.when(F.col("full"), F.lit(float(MAX_COPIES))).otherwise(F.least(F.lit(float(MAX_COPIES)), F.exp(dual * F.col("x"))))


def document_rates(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, n, rate): the dual is solved by Newton steps kept inside a bracket."""
    docs = F.sum("n").over(Window.partitionBy("source"))
    # cells without words neither help nor harm a target
    given = (
        cells.where(F.col("size") > 0)
        .withColumn("docs", docs)
        .alias("c")
        .join(targets.alias("t"), same("c", "t", "source"))
        .select("c.source", "size", "n", "source_size", "target", (F.col("size") * F.col("docs") / F.col("source_size")).alias("x"))
        .withColumn("full", F.col("target") >= F.col("source_size") * MAX_COPIES * (1 - 1e-12))
    )
    given = written(given, "mix-cells")
    state = given.select("source").distinct().select("source", F.lit(0.0).alias("dual"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"))
    state = written(state, "mix-dual")
    for step in range(STEPS + 1):
        if step == STEPS:
            raise RuntimeError(f"some targets are not met after {STEPS} steps")
        at = given.alias("g").join(state.alias("s"), same("g", "s", "source")).select("g.*", "dual", "low", "high", "done")
        rate = _rate(F.col("dual"))
        words = F.col("n") * F.col("size")
        free = F.when(F.col("full") | (rate >= MAX_COPIES), F.lit(0.0)).otherwise(words * F.col("x") * rate)
        sums = at.groupBy("source", "dual", "low", "high", "done").agg(
            F.sum(words * rate).alias("taken"), F.sum(free).alias("slope"), F.first("target").alias("target"), F.first("full").alias("full")
        )
        gap = F.col("taken") - F.col("target")
        # a bracket that can't be halved any more holds the best dual there is
        closed = F.col("high") - F.col("low") <= F.greatest(F.lit(1.0), F.abs("dual")) * 1e-14
        done = F.col("done") | F.col("full") | (F.abs(gap) <= F.col("target") * TOLERANCE) | closed
        low, high = F.when(gap < 0, F.col("dual")).otherwise(F.col("low")), F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high) & (F.abs(newton - F.col("dual")) < 100)
        dual = F.when(done, F.col("dual")).when(inside, newton).otherwise((low + high) / 2)
        state = written(sums.select("source", dual.alias("dual"), low.alias("low"), high.alias("high"), done.alias("done")), "mix-dual")
        if state.where(~F.col("done")).isEmpty():
            break
    solved = given.alias("g").join(state.alias("s"), same("g", "s", "source"))
    return solved.select("g.source", "size", "n", _rate(F.col("dual")).alias("rate"))


def cell_copies(rates: DataFrame) -> DataFrame:
    """(source, size, n, copies): whole copies per cell, by rounding the running sum of the rates."""
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.col("rate")).over(along)
    rounded = rates.withColumn("upto", F.floor(upto + 0.5))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("size")), F.lit(0))
    return rounded.select("source", "size", "n", F.least(F.col("upto") - before, F.col("n") * MAX_COPIES).alias("copies"))


def corrected(copies: DataFrame, targets: DataFrame, passes: int = 3) -> DataFrame:
    """One copy more or less, per pass, of the document size that best closes a source's remaining gap."""
    for _ in range(passes):
        taken = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
        gap = F.col("words") - F.col("target")
        gaps = taken.alias("k").join(targets.alias("t"), same("k", "t", "source")).select("k.source", gap.alias("gap"))
        at = copies.alias("c").join(gaps.alias("g"), same("c", "g", "source")).select("c.*", "gap")
        usable = ((F.col("gap") > 0) & (F.col("copies") > 0)) | ((F.col("gap") < 0) & (F.col("copies") < F.col("n") * MAX_COPIES))
        left = F.abs(F.abs("gap") - F.col("size"))
        best = at.where(usable & (left < F.abs("gap"))).groupBy("source").agg(F.min(F.struct(left.alias("left"), F.col("size"))).alias("best"))
        change = F.when(F.col("size") == F.col("best.size"), -F.signum("gap").cast("bigint")).otherwise(F.lit(0))
        moved = at.alias("a").join(best.alias("b"), same("a", "b", "source"), "left").select("a.*", "b.best")
        copies = written(moved.select("source", "size", "n", (F.col("copies") + F.coalesce(change, F.lit(0))).alias("copies")), "mix-copies")
    return copies


def _sized(docs: DataFrame, text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs``."""
    return _dealt(docs, key, text, source).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def _dealt(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """doc_id, digest, source, size, source_size, target, copies for every row of ``docs``."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(key).alias("doc_id"), F.md5(F.col(text)).alias("digest"), F.col(source).alias("source"), size.alias("size"))
    rows = written(rows, "mix-rows")
    cells = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    targets = written(source_targets(cells), "mix-targets")
    copies = corrected(written(cell_copies(document_rates(cells, targets)), "mix-copies"), targets)
    return assign(rows, cells, copies, targets)


def assign(rows: DataFrame, cells: DataFrame, copies: DataFrame, targets: DataFrame) -> DataFrame:
    """Deal a cell's copies to its documents: one each as far as they go, and again."""
    planned = (
        cells.alias("c")
        .join(targets.alias("t"), same("c", "t", "source"))
        .join(copies.alias("k"), same("c", "k", "source", "size"), "left")
        .select("c.source", "c.size", "c.n", "source_size", "target", F.coalesce("k.copies", F.lit(0)).alias("copies"))
    )
    placed = (
        rows.alias("r")
        .join(planned.alias("p"), same("r", "p", "source", "size"))
        .select("doc_id", "digest", "r.source", "r.size", "n", "source_size", "target", "copies")
    )
    dealt = ranked(placed, ["source", "size"], "n", ["doc_id", "digest"], ["doc_id", "digest"], "rank")
    own = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("rank") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return dealt.withColumn("copies", own.cast("bigint")).drop("rank", "n")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with its own columns.

    Copies belong to rows, found again by source, id and text (by its digest), so ids may repeat or be
    null. Rows equal in all three are alike to the mix and share their copies out evenly.
    """
    names = ["k1", "k2", "k3", "k4", "k5"]

    def keys(of_source: Column, of_id: Column, digest: Column) -> list[Column]:
        plain = [F.coalesce(of_source, F.lit("")), of_source.isNull(), F.coalesce(of_id.cast("string"), F.lit("")), of_id.isNull(), F.coalesce(digest, F.lit(""))]
        return [c.alias(n) for c, n in zip(plain, names)]

    dealt = _dealt(docs, key, text, source)
    times = dealt.groupBy(*keys(F.col("source"), F.col("doc_id"), F.col("digest"))).agg(F.sum("copies").alias("copies"), F.count("*").alias("alike"))
    # written first: the join then meets plain exchanges, and rows that many share can be split
    times = written(times.where(F.col("copies") > 0), "mix-times")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(whole, F.xxhash64(*hashed).alias("order"), *keys(F.col(source), F.col(key), F.md5(F.col(text)))).join(times, names)
    # written as well: the two parts below would each shuffle and sort the texts
    rows = written(rows, "mix-joined")
    number = F.row_number().over(Window.partitionBy(*names).orderBy("order"))
    once = rows.where(F.col("alike") == 1).withColumn("own", F.col("copies"))
    extra = F.when(number <= F.col("copies") % F.col("alike"), 1).otherwise(0)
    several = rows.where(F.col("alike") > 1).withColumn("own", F.floor(F.col("copies") / F.col("alike")) + extra)
    repeats = once.unionByName(several).where(F.col("own") > 0)
    return repeats.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("own").cast("int")))).select("row.*")
