"""Queries of tables that streams keep up to date."""
import uuid

from pyspark.sql import functions as F

from foliocheck.operators import stats as S
from foliocheck.plans.review import decisions
from foliocheck.plans.stats import pages
from foliocheck.session import checkpoint_dir
from foliocheck.sources import corpus, findings as FS
from foliocheck.streaming import jobs, totals as L


def _arrive(spark, parts, schema, keep):
    """Lets the rows of `parts` arrive one after the other, each seen by a stream that goes on where it stopped; returns the folder."""
    run = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in parts:
        part.write.mode("append").parquet(f"{run}/in")
        keep(jobs.read_folder(spark, f"{run}/in", schema, files_per_batch=100_000), f"{run}/table", f"{run}/checkpoint", buckets).awaitTermination()
    return f"{run}/table", buckets


def live_totals(spark, d):
    """Every page and finding reports an older and its present state. In the second and third part a third
    of them report late (the older state last) or twice."""
    at = lambda day: F.expr(f"timestamp '2024-01-0{day} 00:00:00'")
    p, f = pages(spark, d).withColumn("seq", F.lit(0)), FS.findings(spark, d).withColumn("seq", F.lit(0))
    old = L.page_events(p.withColumns({"status": F.lit("processing"), "warning": F.lit("unread"), "ts": at(1)})).unionByName(
        L.finding_events(f.withColumns({"status": F.lit("open"), "severity": F.lit("minor"), "type": F.lit("number"), "ts": at(1)})))
    new = L.page_events(p.withColumn("ts", at(2))).unionByName(L.finding_events(f.withColumn("ts", at(2))))
    third = F.pmod(F.xxhash64("entity", "book_id"), F.lit(3))
    parts = [old.filter(third != 0).unionByName(new.filter(third == 0)), new.filter(third == 1).unionByName(old.filter(third == 0)),
             new.filter(third != 0)]
    path, buckets = _arrive(spark, parts, L.EVENT_SCHEMA, L.totals_to_table)
    t, b = L.totals_table(path, buckets).latest(spark), corpus.books(spark, d)
    summary = L.review_summary(b, t).select("book_id", "success", "pages_reviewed", "visual_pending", "issue_count", "print_ready", "high", "medium", "low", "subjects")
    return (L.book_status(b, t).join(L.progress(b, t).drop("done"), "book_id").join(summary, "book_id")
            .join(S.wide_scores(L.category_scores(b, t)), "book_id")
            .join(L.finding_stats(t), "book_id", "left").fillna(0, ["findings", "critical", "major", "minor", "accepted", "dismissed"]))


def live_decisions(spark, d):
    """The last decision of every finding; those of odd numbers arrive before those of even ones."""
    e = decisions(spark, d)
    half = F.col("seq") % 2
    path, buckets = _arrive(spark, [e.filter(half == 1), e.filter(half == 0)], jobs.decision_table("").schema, jobs.decisions_to_buckets)
    return jobs.decision_table(path, buckets).latest(spark).select("book_id", "page_number", "uid", "status")


QUERIES = {"s6_live_totals": live_totals, "s2_live_decisions": live_decisions}
