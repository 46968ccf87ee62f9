"""Mixing sources to target weights by weighted fair queueing.

Every document of every epoch gets a virtual finish time: the words its source has sent so far, in shuffled order, divided by the source's
target. The copies are cut into ranges of finish time, ranges are summed, and the range that crosses the total budget is sorted and cut
inside. A source so receives words in proportion to its target at every moment, and close to its target at the end.

Running sums are taken per (source, one of 4096 chunks of the shuffled order) on top of the chunks' own totals, so that a source with a third of all
rows is summed by many tasks. Statistics move ids, sizes and hashes only; a text moves once, and only if the caller selects it.

Defined cases: null text has size 0; documents of size 0 are never taken; a null source is a source of its own, last in order; equal rows
are taken one by one; the shuffle depends on doc_id, size and seed alone (the text where there is no id), so reruns agree; an empty table gives no rows; other columns
pass through, those named like an added column are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliocheck.llm.common import WORD, whole
from foliocheck.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
TICKS = 1 << 16        # ranges per unit of virtual time
SEED = 17


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source key (null last), size and place in the shuffled order, next to the other columns of `docs`."""
    size = F.regexp_count(whole("text"), F.lit(WORD)).cast("long")
    rows = (docs.drop("size")
            .withColumns({"__llm_no_source": F.col("source").isNull(), "__llm_src": F.coalesce("source", F.lit("")), "size": size}))
    # Three hexadecimal digits of the place are its chunk.
    id_or_text = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("text"), size.cast("string"), F.xxhash64(whole("text")).cast("string")))
    place = F.md5(F.concat_ws(":", F.lit(str(SEED)), id_or_text))
    return rows.withColumn("__llm_turn", place).withColumn("__llm_chunk", F.conv(F.substring("__llm_turn", 1, 3), 16, 10).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """no_source, src, source_size, target for one row per source (no_source, src, source_size).

    Water filling in closed form: a source is full when the level reaches cap / weight. With the sources in that order, the level is what
    the full ones leave of the total, divided by the weight of the rest, at the first place where it stays below the next source's own.
    Sources are the one thing here that is sorted as a whole: one small row each.
    """
    by_name = Window.orderBy("__llm_no_source", "__llm_src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    everyone = Window.partitionBy(F.lit(1))
    by_fill = Window.orderBy("fill", "__llm_no_source", "__llm_src")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = (sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
            .withColumn("fill", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(everyone))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                        / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
            .withColumn("water", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everyone)))
    return rows.select("__llm_no_source", "__llm_src", "source_size", F.least(F.col("cap"), F.col("weight") * F.coalesce("water", F.lit(0.0))).alias("target"))


def _chunk_totals(base: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Per source and chunk: words before it, the source's size and target."""
    chunks = base.groupBy("__llm_no_source", "__llm_src", "__llm_chunk").agg(F.sum("size").alias("chunk_size"))
    source = Window.partitionBy("__llm_no_source", "__llm_src")
    chunks = chunks.select("__llm_no_source", "__llm_src", "__llm_chunk",
                           (F.sum("chunk_size").over(source.orderBy("__llm_chunk")) - F.col("chunk_size")).alias("__llm_before"),
                           F.sum("chunk_size").over(source).alias("source_size"))
    goal = targets(chunks.groupBy("__llm_no_source", "__llm_src").agg(F.max("source_size").alias("source_size")), weights, max_epochs)
    return chunks.join(goal.drop("source_size"), ["__llm_no_source", "__llm_src"])


def _sent(rows: DataFrame) -> DataFrame:
    """Adds `sent`, the words of the source up to and including this document in shuffled order."""
    order = Window.partitionBy("__llm_no_source", "__llm_src", "__llm_chunk").orderBy("__llm_turn", "doc_id", "size")
    return rows.withColumn("__llm_sent", F.col("__llm_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _finish(epoch: int | Column) -> Column:
    """Virtual finish time of a copy; null for copies that are never served."""
    able = (F.col("size") > 0) & (F.col("target") > 0)
    return F.when(able, (epoch * F.col("source_size") + F.col("__llm_sent")) / F.col("target"))


def _tick(finish: Column) -> Column:
    # Beyond twice its target hardly any source is served; such copies stay in one last range.
    return F.least(F.floor(finish * TICKS), F.lit(2 * TICKS)).cast("int")


def _place(finish: Column) -> Column:
    """Total order of copies: within a source `sent` grows with every document that has words."""
    return F.struct(finish.alias("finish"), F.col("__llm_no_source"), F.col("__llm_src"), F.col("__llm_sent"))


def _cut(rows: DataFrame, budget: DataFrame, max_epochs: int) -> DataFrame:
    """One row: `tick`, the range in which the budget ends, and `last`, the last copy served inside it."""
    copies = (rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
              .withColumn("finish", _finish(F.col("epoch"))).filter(F.col("finish").isNotNull()).withColumn("tick", _tick(F.col("finish"))))
    # Words per range: summed over groups of 256 ranges, then inside each group.
    ticks = copies.groupBy("tick").agg(F.sum("size").alias("words")).withColumn("group", F.shiftright("tick", 8))
    groups = ticks.groupBy("group").agg(F.sum("words").alias("words"))
    groups = groups.select("group", (F.sum("words").over(Window.orderBy("group")) - F.col("words")).alias("ahead"))
    ahead = F.col("ahead") + F.sum("words").over(Window.partitionBy("group").orderBy("tick")) - F.col("words")
    room = (ticks.join(groups, "group").select("tick", (budget.scalar() - ahead).alias("room")).filter(F.col("room") >= 0)
            .agg(F.max_by(F.struct("tick", "room"), "tick").alias("cut")))
    # Only the copies of that one range are sorted: one part in TICKS of what is served.
    sure = copies.select(_place(F.col("finish")).alias("place"), "size", "tick", room.scalar().alias("cut")).filter(F.col("tick") == F.col("cut.tick"))
    into = F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return sure.withColumn("into", into).agg(F.struct(
        F.max("tick").alias("tick"), F.max(F.when(F.col("into") <= F.col("cut.room"), F.col("place"))).alias("last")).alias("cut"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`docs` with size, source_size, target, copies and taken (words the mix takes, repeats counted).

    Sizes are counted once, into a checkpoint of ids and numbers; totals and the cut come from there. The rows themselves are shuffled once
    by (source, chunk), with the columns that the caller selects from the result.
    """
    key = ["__llm_no_source", "__llm_src", "__llm_chunk"]
    lean = cut_lineage(sized(docs.select("doc_id", "text", "source")).drop("text", "source"))
    totals = cut_lineage(_chunk_totals(lean, weights, max_epochs))
    cut = _cut(_sent(lean.join(totals, key)), totals.select("__llm_no_source", "__llm_src", "source_size").distinct().agg(F.sum("source_size").alias("budget")), max_epochs)
    added = ["size", "source_size", "target", "copies", "taken"]
    rows = _sent(sized(docs.drop(*added)).join(totals, key)).withColumn("__llm_cut", cut.scalar())
    copies = F.lit(0)
    for epoch in range(max_epochs):
        at = _finish(epoch)
        served = (_tick(at) < F.col("__llm_cut.tick")) | ((_tick(at) == F.col("__llm_cut.tick")) & (_place(at) <= F.col("__llm_cut.last")))
        copies = copies + F.coalesce(served, F.lit(False)).cast("int")
    rows = rows.withColumn("copies", copies)
    return rows.select(*[c for c in docs.columns if c.lower() not in added],
                       "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
