"""Review state: decisions, late geometry, stable numbers, revisions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliocheck import constants as C

BOX = ["xmin", "ymin", "xmax", "ymax"]


def identity() -> Column:
    """Page and uid of a finding, or page, number and texts where it has no uid yet."""
    page = F.col("page_number").cast("string")
    return F.when(F.coalesce("uid", F.lit("")) != "", F.concat_ws(":", page, "uid")).otherwise(
        F.concat_ws(":", page, F.col("id").cast("string"), "quote", "suggestion"))


def apply_geometry(current: DataFrame, located: DataFrame) -> DataFrame:
    """Boxes of a late geometry result, and nothing else of it; rows it alone has are dropped."""
    g = located.select("book_id", identity().alias("ident"), F.lit(True).alias("has"), *[F.col(b).alias("n_" + b) for b in BOX],
                       F.col("box_source").alias("n_source"))
    j = current.withColumn("ident", identity()).join(g, ["book_id", "ident"], "left")
    cols = {b: F.when(F.col("has"), F.col("n_" + b)).otherwise(F.col(b)) for b in BOX}
    cols["box_source"] = F.when(F.col("has"), F.col("n_source")).otherwise(F.col("box_source"))
    return j.withColumns(cols).select(current.columns)


def keep_measured(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """A box measured earlier stays where the new one is not measured."""
    e = earlier.filter(F.col("box_source").isin(C.MEASURED_SOURCES) & F.col("xmin").isNotNull()).select(
        "book_id", identity().alias("ident"), *[F.col(b).alias("o_" + b) for b in BOX], F.col("box_source").alias("o_source"))
    j = current.withColumn("ident", identity()).join(e, ["book_id", "ident"], "left")
    use = F.col("o_source").isNotNull() & ~(F.coalesce(F.col("box_source").isin(C.MEASURED_SOURCES), F.lit(False)) & F.col("xmin").isNotNull())
    cols = {b: F.when(use, F.col("o_" + b)).otherwise(F.col(b)) for b in BOX}
    cols["box_source"] = F.when(use, F.col("o_source")).otherwise(F.col("box_source"))
    return j.withColumns(cols).select(current.columns)


def stable_ids(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Numbers of known findings stay; new ones count on from the highest, in order.

    `incoming` has `ord`, `current` has `id`; both are keyed by book, page and uid.
    """
    known = current.filter("uid <> ''").select("book_id", "page_number", "uid", F.col("id").alias("known_id"))
    top = current.groupBy("book_id").agg(F.max("id").alias("top"))
    j = incoming.join(known, ["book_id", "page_number", "uid"], "left").join(top, "book_id", "left")
    fresh = F.sum(F.col("known_id").isNull().cast("int")).over(
        W.partitionBy("book_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow))
    return j.withColumn("id", F.coalesce("known_id", F.greatest(F.lit(0), F.coalesce("top", F.lit(0))) + fresh).cast("bigint")).drop("known_id", "top")


def merge_reviews(incoming: DataFrame, current: DataFrame, pending: DataFrame, stale: bool) -> DataFrame:
    """Review flags of a fresh snapshot: a decision still on its way wins; a snapshot older than
    the last decision keeps the current flags."""
    p = pending.select("uid", F.col("status").alias("p_status"))
    c = current.select("book_id", "page_number", "uid", F.col("resolved").alias("c_resolved"), F.col("ignored").alias("c_ignored"))
    j = incoming.join(p, "uid", "left").join(c, ["book_id", "page_number", "uid"], "left")
    prior = F.lit(stale) & F.col("c_resolved").isNotNull()
    waiting = F.col("p_status").isNotNull()
    return j.withColumns({
        "resolved": F.when(waiting, F.col("p_status") == "accepted").when(prior, F.col("c_resolved")).otherwise(F.col("resolved")),
        "ignored": F.when(waiting, F.col("p_status") == "dismissed").when(prior, F.col("c_ignored")).otherwise(F.col("ignored")),
    }).select(incoming.columns)


def validate_issue_map(mapping: DataFrame, findings: DataFrame) -> DataFrame:
    """Per book: may the sidebar numbering (number, uid, page) be used? One bad row rejects it."""
    f = findings.select("book_id", "uid", F.col("page_number").alias("real_page"))
    numbers = mapping.groupBy("book_id", "number").agg(F.count("*").alias("n_copies"))
    uids = mapping.groupBy("book_id", "uid").agg(F.count("*").alias("u_copies"))
    j = (mapping.join(f, ["book_id", "uid"], "left").join(numbers, ["book_id", "number"]).join(uids, ["book_id", "uid"]))
    bad = (F.col("real_page").isNull() | (F.col("page") != F.col("real_page")) | ~F.col("number").between(1, 5000)
           | (F.col("n_copies") > 1) | (F.col("u_copies") > 1))
    g = j.groupBy("book_id").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_rows"))
    return g.withColumn("accepted", (F.col("bad_rows") == 0) & (F.col("rows") <= 5000))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Last decision per finding; partial maxima are taken before rows are exchanged."""
    return decisions.groupBy("book_id", "page_number", "uid").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("decided"), F.count("*").alias("decisions"))


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with their last decision, and the decisions whose finding does not exist."""
    last = latest_decisions(decisions.filter(F.col("status").isin(C.STATUSES)))
    keys = ["book_id", "page_number", "uid"]
    done = findings.join(last.drop("decisions"), keys, "left").withColumn("status", F.coalesce("decided", "status")).drop("decided")
    unknown = last.join(findings.select(keys), keys, "left_anti")
    return done.select(findings.columns), unknown


def split_updates(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Outcome of page updates: the first one that names the current revision and the running
    claim is accepted, later or older ones are stale and must be reconciled again, the rest is
    refused.

    `state`: page key, revision, run_id. `updates`: update_id, page key, base_revision, run_id.
    """
    s = state.select("book_id", "page_number", "revision", F.col("run_id").alias("running"))
    j = updates.join(s, ["book_id", "page_number"], "left")
    j = j.withColumn("refused", F.col("revision").isNull() | (F.col("run_id") != F.col("running")))
    current = ~F.col("refused") & (F.col("base_revision") == F.col("revision"))
    winners = j.filter(current).groupBy("book_id", "page_number").agg(F.min("update_id").alias("winner"))
    j = j.join(winners, ["book_id", "page_number"], "left")
    return j.select("update_id", "book_id", "page_number", F.when(F.col("refused"), "refused").when(
        F.coalesce(F.col("update_id") == F.col("winner"), F.lit(False)), "accepted").otherwise("stale").alias("outcome"))
