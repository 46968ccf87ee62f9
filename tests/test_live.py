"""Tables kept by streams: equal to the batch results after every batch, and rewritten only where touched."""
import datetime as dt
import os

from pyspark.sql import Window as W, functions as F

from foliocheck.operators import findings as O, review as R, stats as S
from foliocheck.streaming import jobs, totals as L
from foliocheck.streaming.buckets import BucketTable

T0 = dt.datetime(2024, 1, 1)
BOOKS = "book_id string, status string, page_count bigint"
PAGE = ("book_id string, page_number int, status string, evidence_prepared boolean, warning string, coverage_complete boolean, "
        "subject_key string, ts timestamp, seq bigint")
FOUND = ("book_id string, page_number int, uid string, type string, severity string, status string, box_source string, "
         "xmin double, ymin double, xmax double, ymax double, ts timestamp, seq bigint")


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def page(n, status, minute, seq=0, book="b", ready=True, warning="", whole=True, subject="MATH"):
    return (book, n, status, ready, warning, whole, subject, at(minute), seq)


def found(uid, status, minute, seq=0, severity="major", type="grammar", book="b"):
    return (book, 1, uid, type, severity, status, "ai", 1.0, 1.0, 2.0, 2.0, at(minute), seq)


BATCHES = [
    ([page(1, "processing", 1), page(2, "processing", 1, subject="ART"), page(1, "done", 1, book="c")], [found("x", "open", 1), found("y", "open", 1, severity="critical")]),
    ([page(1, "done", 2, warning="unclear"), page(2, "processing", 0, subject="LATE")], [found("x", "accepted", 3), found("x", "open", 2), found("z", "open", 1, type="image")]),
    ([page(1, "done", 2, warning="unclear"), page(2, "error", 5, subject="")], [found("x", "open", 2), found("y", "dismissed", 4, severity="minor"), found("y", "dismissed", 4, severity="minor")]),
    ([page(1, "done", 6), page(3, None, 6, ready=None, warning=None, whole=None, subject=None)], [found("x", "open", 3, seq=1), found("w", None, 1, severity=None, type=None, book=None)]),
    ([], [found("y", "dismissed", 4, severity="minor")]),
]


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def present(df, keys):
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq")))
    return df.withColumn("rn", newest).filter("rn = 1").drop("rn")


def test_totals_equal_batch_after_every_batch(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    books = spark.createDataFrame([("b", "processing", 3), ("c", "done", 1), ("d", "queued", 0)], BOOKS)
    seen_pages, seen_found = [], []
    for pages, findings in BATCHES:
        p, f = spark.createDataFrame(pages, PAGE), spark.createDataFrame(findings, FOUND)
        L.page_events(p).unionByName(L.finding_events(f)).coalesce(1).write.mode("append").parquet(source)
        L.totals_to_table(jobs.read_folder(spark, source, L.EVENT_SCHEMA, 100), table, str(tmp_path / "cp"), 4).awaitTermination()
        seen_pages, seen_found = seen_pages + pages, seen_found + findings
        p = present(spark.createDataFrame(seen_pages, PAGE), ["book_id", "page_number"])
        f = present(spark.createDataFrame(seen_found, FOUND), ["book_id", "uid"])
        view, totals = O.review_view(f), L.totals_table(table, 4).latest(spark)
        assert totals.filter("n <= 0").count() == 0
        assert rows(L.book_status(books, totals)) == rows(S.book_status(books, p))
        assert rows(L.progress(books, totals)) == rows(S.progress(books, p))
        assert rows(L.finding_stats(totals)) == rows(S.finding_stats(f))
        assert rows(L.review_summary(books, totals)) == rows(S.review_summary(books, p, view))
        assert rows(L.category_scores(books, totals)) == rows(S.category_scores(books, view))


def test_an_event_without_measures_takes_its_finding_out(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    first = L.finding_events(spark.createDataFrame([found("x", "open", 1), found("y", "open", 1)], FOUND))
    for part in (first, first.filter("entity LIKE '%x'").selectExpr("book_id", "entity", "ts + interval 1 day AS ts", "seq", f"CAST(array() AS {L.MEASURES}) AS measures"),
                 first.filter("entity LIKE '%y'").selectExpr("book_id", "entity", "ts + interval 1 day AS ts", "seq", f"CAST(NULL AS {L.MEASURES}) AS measures")):
        part.coalesce(1).write.mode("append").parquet(source)
        L.totals_to_table(jobs.read_folder(spark, source, L.EVENT_SCHEMA, 100), table, str(tmp_path / "cp"), 4).awaitTermination()
    assert L.totals_table(table, 4).latest(spark).count() == 0


DECISION = "book_id string, page_number int, uid string, status string, ts timestamp, seq bigint"


def test_decisions_by_bucket_equal_batch(spark, tmp_path):
    data = [[("b", 1, "a", "accepted", at(1), 1), ("b", 1, "x", "fixed", at(1), 3)], [("b", 1, "a", "dismissed", at(2), 2)],
            [("b", 1, "a", "open", at(1), 9), ("b", 1, "a", "dismissed", at(2), 2), (None, None, None, "fixed", None, None)]]
    for part in data:
        spark.createDataFrame(part, DECISION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.decisions_to_buckets(jobs.read_folder(spark, str(tmp_path / "in"), DECISION), str(tmp_path / "t"), str(tmp_path / "cp"), 8).awaitTermination()
    got = {(r.book_id, r.uid, r.status) for r in jobs.decision_table(str(tmp_path / "t"), 8).latest(spark).collect()}
    want = {(r.book_id, r.uid, r.decided) for r in R.latest_decisions(spark.createDataFrame([r for p in data for r in p], DECISION)).collect()}
    assert {g for g in got if g[0]} == {w for w in want if w[0]} == {("b", "a", "dismissed"), ("b", "x", "fixed")}
    assert (None, None, "fixed") in got


def written(path):
    return sum(os.path.getsize(os.path.join(folder, f)) for folder, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_bytes_written_grow_with_the_batch_and_old_folders_go(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), "k string, v string", ("k",), 16)
    big = spark.range(20_000).selectExpr("CAST(id AS STRING) AS k", "sha2(CAST(id AS STRING), 256) AS v")
    table.write(big, 0, table.touched(big))
    whole = written(tmp_path / "t" / "rows" / "batch=0")
    for n in range(1, 5):
        one = spark.createDataFrame([("7", f"new {n}")], "k string, v string")
        reached = table.touched(one)
        kept = table.read(spark, n - 1, reached).filter("k <> '7'").unionByName(one)
        table.write(kept, n, reached)
        assert len(reached) == 1 and written(tmp_path / "t" / "rows" / f"batch={n}") < whole / 8
    now = table.latest(spark)
    assert now.count() == 20_000 and now.filter("k = '7'").first().v == "new 4"
    assert sorted(os.listdir(tmp_path / "t" / "current")) == ["batch=3", "batch=4"]
    assert written(tmp_path / "t" / "rows" / "batch=1") == 0 == written(tmp_path / "t" / "rows" / "batch=2")


def test_a_repeated_batch_and_an_emptied_bucket(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), "k string, v bigint", ("k",), 4)
    rows_ = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v bigint")
    assert table.latest(spark).count() == 0
    for n in (0, 1, 1):     # batch 1 fails after it wrote and runs again
        more = table.read(spark, n - 1, {0, 1, 2, 3}).unionByName(rows_).groupBy("k").agg(F.sum("v").alias("v"))
        table.write(more, n, {0, 1, 2, 3})
    assert {(r.k, r.v) for r in table.latest(spark).collect()} == {("a", 2), ("b", 4)}
    table.write(rows_.limit(0), 2, {0, 1, 2, 3})
    assert table.latest(spark).count() == 0
    table.write(rows_.filter("k = 'a'"), 3, table.touched(rows_.filter("k = 'a'")))
    assert [(r.k, r.v) for r in table.latest(spark).collect()] == [("a", 1)]
