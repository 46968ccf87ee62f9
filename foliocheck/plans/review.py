"""Queries of identity, reconciliation and review state."""
import datetime as dt

from pyspark.sql import Window as W, functions as F

from foliocheck.operators import findings as O, identity as I, review as R
from foliocheck.sources import corpus, findings as FS, seeds

NOW = dt.datetime(2024, 3, 1)
BOX = R.BOX


def detected(f):
    """Findings of a second run over the findings of a first: the same places under other uids, some with another type, plus
    some without a place."""
    f = f.filter("doc_id % 4 <> 1")
    f = f.withColumn("type", F.expr("CASE WHEN doc_id % 6 = 0 AND source = 'linter' THEN 'inconsistency' ELSE type END"))
    f = f.withColumn("xmin", F.expr("CASE WHEN source = 'ai' THEN xmin + 5 ELSE xmin END"))
    return f.withColumn("uid", F.sha2(F.concat("uid", F.lit("#2")), 256)).withColumn("seq", F.col("seq") + 1000000000).withColumn("status", F.lit("open"))


def both_runs(spark, d):
    f = FS.findings(spark, d)
    return f.unionByName(detected(f))


def j12(spark, d):
    return I.duplicate_pairs(both_runs(spark, d))


def f9(spark, d):
    return I.merge_findings(both_runs(spark, d)).drop("seq", "explanation")


def history(f):
    first = F.lit(dt.datetime(2024, 1, 1))
    return f.select(*I.MERGE_COLUMNS, F.lit(True).alias("seen_in_latest"), first.alias("first_detected_at"),
                                        first.alias("last_detected_at"))


def s1(spark, d):
    f = FS.findings(spark, d)
    r = I.reconcile(history(f), detected(f), NOW)
    return r.select("uid", "page_number", "type", "status", "seen_in_latest", F.unix_timestamp("first_detected_at").alias("first_s"),
                    F.unix_timestamp("last_detected_at").alias("last_s"))


def with_id(f):
    return f.withColumn("id", F.row_number().over(W.partitionBy("book_id").orderBy("page_number", "seq", "uid")).cast("bigint"))


def j15(spark, d):
    cur = with_id(FS.findings(spark, d))
    late = cur.filter("doc_id % 2 = 0").withColumn("xmin", F.expr("CASE WHEN doc_id % 4 = 0 THEN xmin + 1 END")).withColumn(
        "box_source", F.expr("CASE WHEN doc_id % 4 = 0 THEN 'pdf_text' ELSE 'unverified' END"))
    out = R.keep_measured(R.apply_geometry(cur, late), cur)
    return out.select("uid", "id", *BOX, "box_source", "status")


def j16(spark, d):
    v = O.review_view(FS.findings(spark, d)).select("book_id", "page_number", "doc_id", "uid", "resolved", "ignored")
    cur = v.filter("doc_id % 3 <> 1").withColumn("resolved", ~F.col("resolved")).withColumn("ignored", F.lit(False))
    pend = v.filter("doc_id % 5 = 2").select("uid", F.expr("CASE doc_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'dismissed' ELSE 'open' END").alias("status"))
    fresh = R.merge_reviews(v, cur, pend, stale=False).select("uid", F.lit("fresh").alias("snapshot"), "resolved", "ignored")
    return fresh.unionByName(R.merge_reviews(v, cur, pend, stale=True).select("uid", F.lit("stale").alias("snapshot"), "resolved", "ignored"))


def j17(spark, d):
    f = with_id(FS.findings(spark, d))
    cur = f.filter("doc_id % 3 <> 0").select("book_id", "page_number", "uid", (F.col("id") * 2).alias("id"))
    inc = f.select("book_id", "page_number", "uid", F.col("id").alias("ord"))
    return R.stable_ids(inc, cur).select("book_id", "page_number", "uid", "id")


def j18(spark, d):
    f = with_id(FS.findings(spark, d))
    m = f.select("book_id", F.expr("CASE WHEN doc_id = 7 THEN 'gone' ELSE uid END").alias("uid"),
                 F.expr("CASE WHEN doc_id % 400 = 63 THEN 6000 ELSE id END").alias("number"),
                 F.expr("CASE WHEN doc_id % 350 = 105 THEN page_number + 1 ELSE page_number END").alias("page"))
    return R.validate_issue_map(m, FS.findings(spark, d))


def decisions(spark, d, findings=None):
    """Decisions from the event stream: each event decides one of the findings of its page."""
    rank = F.row_number().over(W.partitionBy("book_id", "page_number").orderBy("seq", "uid")) - 1
    f = (FS.findings(spark, d) if findings is None else findings).select("book_id", "page_number", "uid", rank.alias("rank"))
    e = corpus.table(spark, d, "events").withColumn("doc_id", F.expr("event_id div 10")).selectExpr(
        f"{seeds.book_id('div')} AS book_id", f"{seeds.PAGE_NUMBER} AS page_number", "ts", "event_id AS seq", "event_type",
        "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'dismissed' WHEN 'view' THEN 'open' WHEN 'signup' THEN 'fixed' "
        "ELSE 'accepted' END AS status", "CAST(event_id % 3 AS INT) AS rank")
    j = e.join(f, ["book_id", "page_number", "rank"], "left")
    uid = F.when(F.col("event_type") == "click", F.concat(F.lit("gone-"), F.col("seq") % 50)).otherwise(F.coalesce("uid", F.concat(F.lit("none-"), "rank")))
    return j.select("book_id", "page_number", uid.alias("uid"), "status", "ts", "seq")


def s2(spark, d):
    f = FS.findings(spark, d)
    done, unknown = R.apply_decisions(f, decisions(spark, d, f))
    a = done.select("book_id", "page_number", "uid", "status", F.lit("finding").alias("kind"))
    return a.unionByName(unknown.select("book_id", "page_number", "uid", F.col("decided").alias("status"), F.lit("unknown").alias("kind")))


def s3(spark, d):
    state = corpus.pages(spark, d, text=False).selectExpr("book_id", "page_number", "CAST(doc_id % 4 AS INT) AS revision", "concat('r', doc_id % 2) AS run_id")
    up = corpus.table(spark, d, "events").withColumn("doc_id", F.expr("event_id div 7")).selectExpr(
        "event_id AS update_id", f"{seeds.book_id('div')} AS book_id", f"{seeds.PAGE_NUMBER} AS page_number",
        "CAST(event_id % 4 AS INT) AS base_revision", "CASE WHEN event_id % 13 = 0 THEN 'revoked' ELSE concat('r', doc_id % 2) END AS run_id")
    return R.split_updates(state, up)


QUERIES = {
    "j12_duplicate_pairs": j12, "f9_merge_findings": f9, "s1_reconcile": s1, "j15_apply_geometry": j15, "j16_merge_reviews": j16,
    "j17_stable_ids": j17, "j18_validate_issue_map": j18, "s2_apply_decisions": s2, "s3_commit_split": s3,
}
