"""Totals of books that follow every change of a page or finding.

An event carries the measures its page or finding counts towards. The newest event of each is kept;
when it changes, what the old one counted is subtracted and what the new one counts is added. Late
events (older than the one kept) and repeated ones change nothing; an event without measures takes
its page or finding out of all totals. Of events equal in `ts` and `seq`
the one with the greater measures holds; a null `ts` is older than any.

Minima, sets and "all of them" cannot be subtracted, so these are counted per value (`item`, `at`):
the smallest processing page is the smallest `at` whose count is above zero.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from foliocheck import constants as C
from foliocheck.operators import findings as O, stats as S
from foliocheck.streaming.buckets import BucketTable

MEASURES = "array<struct<measure:string,item:string,at:bigint>>"
EVENT_SCHEMA = f"book_id string, entity string, ts timestamp, seq bigint, measures {MEASURES}"
EVENT_COLUMNS = ["book_id", "entity", "ts", "seq", "measures"]
TOTAL_KEYS = ("book_id", "measure", "item", "at")


def _measures(*counted: tuple[Column, str, Column | None, Column | None]) -> Column:
    """The measures whose condition holds; a condition that is null does not."""
    each = [F.when(holds, F.struct(F.lit(name).alias("measure"), (F.lit("") if item is None else item).alias("item"),
                                   (F.lit(0) if at is None else at).cast("bigint").alias("at"))) for holds, name, item, at in counted]
    return F.filter(F.array(*each), lambda m: m.isNotNull()).cast(MEASURES)


def page_events(pages: DataFrame) -> DataFrame:
    """Events of page rows with `ts` and `seq`."""
    status, number, warned = F.col("status"), F.col("page_number"), F.col("warning") != ""
    counted = [(F.lit(True), "pages", None, None), *[(status == s, s, None, None) for s in ("done", "error", "pending", "processing")],
               (F.col("evidence_prepared"), "indexed", None, None), (status == "processing", "processing_page", None, number),
               ((status != "done") | warned, "visual_pending", None, None), (~(~warned & F.col("coverage_complete")), "unclean", None, None),
               (F.col("subject_key") != "", "subject", F.col("subject_key"), number)]
    return pages.select("book_id", F.concat_ws(":", F.lit("page"), number).alias("entity"), "ts", "seq", _measures(*counted).alias("measures"))


def finding_events(findings: DataFrame) -> DataFrame:
    """Events of finding rows with `ts` and `seq`."""
    view = O.review_view(findings.withColumn("found_severity", F.col("severity")))
    counted = [(F.lit(True), "findings", None, None), *[(F.col("found_severity") == s, f"found:{s}", None, None) for s in C.SEVERITIES],
               *[(F.col("status") == s, s, None, None) for s in ("accepted", "dismissed")],
               *[(F.col("severity") == s, f"seen:{s}", None, None) for s in ("critical", "high", "medium", "low")],
               (~F.col("resolved") & ~F.col("ignored"), "open", S.score_bucket(F.col("category")), None)]
    return view.select("book_id", F.concat_ws(":", F.lit("finding"), "page_number", "uid").alias("entity"), "ts", "seq", _measures(*counted).alias("measures"))


def _kept_table(path: str, buckets: int) -> BucketTable:
    # `was`: what a row that changed in the last batch counted before; null in rows that did not change.
    return BucketTable(f"{path}/kept", f"{EVENT_SCHEMA}, was {MEASURES}", ("book_id", "entity"), buckets)


def totals_table(path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(f"{path}/totals", "book_id string, measure string, item string, at bigint, n bigint", TOTAL_KEYS, buckets)


def _newest(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    both = kept.select(*EVENT_COLUMNS, F.lit(True).alias("old")).unionByName(fresh.select(
        *EVENT_COLUMNS[:-1], F.coalesce("measures", F.array().cast(MEASURES)).alias("measures"), F.lit(False).alias("old")))
    state = F.struct("ts", "seq", "measures")
    g = both.groupBy("book_id", "entity").agg(F.max(state).alias("now"), F.max(F.when(F.col("old"), F.col("measures"))).alias("before"))
    changed = ~F.col("before").eqNullSafe(F.col("now.measures"))
    return g.select("book_id", "entity", "now.*", F.when(changed, F.coalesce("before", F.array().cast(MEASURES))).alias("was"))


def _deltas(changed: DataFrame) -> DataFrame:
    def signed(col: str, n: int) -> Column:
        return F.transform(col, lambda m: F.struct(m["measure"].alias("measure"), m["item"].alias("item"), m["at"].alias("at"), F.lit(n).cast("bigint").alias("n")))
    rows = changed.filter("was IS NOT NULL").select("book_id", F.explode(F.concat(signed("was", -1), signed("measures", 1))).alias("d"))
    return _summed(rows.select("book_id", "d.*"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*TOTAL_KEYS).agg(F.sum("n").alias("n")).filter("n <> 0")


def totals_to_table(events: DataFrame, path: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Keeps `totals_table(path)` up to date with a stream of events (`EVENT_COLUMNS`).

    Both tables are cut by hashes of their whole keys, so no book or source gathers in one bucket.
    """
    kept, totals = _kept_table(path, buckets), totals_table(path, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reached = kept.touched(batch)
        kept.write(_newest(kept.read(spark, batch_id - 1, reached), batch), batch_id, reached)
        deltas = _deltas(kept.read(spark, batch_id, reached))
        moved = totals.touched(deltas)
        totals.write(_summed(totals.read(spark, batch_id - 1, moved).unionByName(deltas)), batch_id, moved)
    writer = events.select(*EVENT_COLUMNS).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _n(measure: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))


def page_counts(totals: DataFrame) -> DataFrame:
    return totals.groupBy("book_id").agg(
        *[_n(m).alias(a) for m, a in (("pages", "pages"), ("done", "done"), ("error", "failed"), ("pending", "pending"), ("processing", "processing"), ("indexed", "indexed"))],
        F.min(F.when(F.col("measure") == "processing_page", F.col("at"))).alias("processing_page")).filter("pages > 0")


def book_status(books: DataFrame, totals: DataFrame) -> DataFrame:
    return S.status_of(books, page_counts(totals))


def progress(books: DataFrame, totals: DataFrame) -> DataFrame:
    return S.progress_of(books, page_counts(totals))


def finding_stats(totals: DataFrame) -> DataFrame:
    return totals.groupBy("book_id").agg(_n("findings").alias("findings"), *[_n(f"found:{s}").alias(s) for s in C.SEVERITIES],
                                         *[_n(s).alias(s) for s in ("accepted", "dismissed")]).filter("findings > 0")


def review_summary(books: DataFrame, totals: DataFrame) -> DataFrame:
    per_book = totals.groupBy("book_id")
    p = per_book.agg(_n("pages").alias("pages"), _n("done").alias("pages_reviewed"), _n("error").alias("failed"), _n("visual_pending").alias("visual_pending"),
                     (_n("unclean") == 0).alias("all_clean")).filter("pages > 0").drop("pages")
    subjects = totals.filter("measure = 'subject'").groupBy("book_id", F.col("item").alias("subject_key")).agg(F.min("at").alias("first"))
    f = per_book.agg(_n("findings").alias("issue_count"), *[_n(f"seen:{s}").alias(s) for s in ("critical", "high", "medium", "low")]).filter("issue_count > 0")
    return S.summary_of(books, p, subjects, f)


def category_scores(books: DataFrame, totals: DataFrame) -> DataFrame:
    n = totals.filter("measure = 'open'").groupBy("book_id", F.col("item").alias("bucket")).agg(F.sum("n").alias("n"))
    return S.scores_of(books, n)
