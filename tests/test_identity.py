"""Identity, reconciliation, review state, and the streaming forms of both."""
import datetime as dt

from pyspark.sql import functions as F

from foliocheck.operators import identity as I, review as R
from foliocheck.streaming import jobs
from tests.test_ground import FINDING

T1, T2, T3 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)
BASE = dict(uid="base", book_id="b", page_number=1, seq=1, type="typography", severity="minor", quote="will Complete the figure.",
            suggestion="will complete the figure.", explanation="", xmin=100.0, ymin=100.0, xmax=350.0, ymax=125.0, box_source="pdf_text",
            source="ai", text_start=15, text_end=40, confidence=0.98, status="open")
ORDER = [c.split()[0] for c in FINDING.split(", ")]


def f(**kw):
    return {**BASE, **kw}


def rows(*fs):
    return [tuple({**x, "seq": i}[c] for c in ORDER) for i, x in enumerate(fs)]


PAIRS = [
    (f(uid="x", text_start=55, ymin=500.0, ymax=525.0), 2),
    (f(uid="x", text_start=None, box_source="unverified"), 2),
    (f(uid="x", suggestion="will complete the figures."), 2),
    (f(uid="x", quote="Complete", suggestion="complete", text_start=20), 1),
    (f(uid="x", quote="Complete", suggestion="complete", text_start=60), 2),
    (f(uid="x", type="inconsistency"), 1),
    (f(uid="x", type="image"), 2),
    (f(uid="x", type="inconsistency", box_source="ai"), 2),
    (f(uid="x", text_start=None, xmin=110.0), 1),
]


def test_merge_pairs(spark):
    data = []
    for page, (other, _) in enumerate(PAIRS):
        data += rows(f(page_number=page), {**other, "page_number": page})
    df = spark.createDataFrame(data, FINDING)
    counts = {r.page_number: r["count"] for r in I.merge_findings(df).groupBy("page_number").count().collect()}
    assert [counts[i] for i in range(len(PAIRS))] == [n for _, n in PAIRS]
    pairs = {r.l_uid for r in I.duplicate_pairs(df.withColumn("uid", F.concat("uid", F.col("page_number").cast("string")))).collect()}
    assert pairs == {f"base{i}" for i, (_, n) in enumerate(PAIRS) if n == 1}


def test_sign_change_keeps_first(spark):
    a = f(uid="n", type="number", quote="+1", suggestion="−1", status="accepted")
    b = f(uid="m", type="inconsistency", quote="+1", suggestion="-1")
    out = I.merge_findings(spark.createDataFrame(rows(a, b), FINDING)).collect()
    assert len(out) == 1 and out[0]["uid"] == "n" and out[0]["status"] == "accepted"


def test_later_measured_place_is_taken_over(spark):
    guess = f(uid="g", box_source="unverified", xmin=0.0, ymin=0.0, xmax=1000.0, ymax=1000.0)
    fixed = f(uid="m", xmin=10.0)
    moved = f(uid="o", text_start=400, box_source="unverified")
    out = {r.uid: r for r in I.merge_findings(spark.createDataFrame(rows(guess, fixed, moved), FINDING)).collect()}
    assert set(out) == {"g", "o"} and out["g"].xmin == 10.0 and out["g"].box_source == "pdf_text" and out["g"].text_start == 15


def runs():
    first = [f(uid="a", status="accepted"), f(uid="d", text_start=70, quote="Second :", suggestion="Second: ", status="dismissed", ymin=600.0, ymax=620.0)]
    second = [f(uid="new"), f(uid="h", quote="Heading :", suggestion="Heading: ", text_start=90, ymin=800.0, ymax=820.0)]
    return first, second


def test_reconcile_batch(spark):
    first, second = runs()
    det1 = spark.createDataFrame(rows(*first), FINDING)
    empty = spark.createDataFrame([], I.HISTORY_SCHEMA)
    h1 = I.reconcile(empty, det1, T1)
    h2 = I.reconcile(h1, spark.createDataFrame(rows(*second), FINDING), T2)
    got = {r.uid: r for r in h2.collect()}
    assert set(got) == {"a", "d", "h"}
    assert got["a"].status == "accepted" and got["a"].first_detected_at == T1 and got["a"].last_detected_at == T2 and got["a"].seen_in_latest
    assert not got["d"].seen_in_latest and got["d"].last_detected_at == T1 and got["d"].status == "dismissed"
    h3 = {r.uid: r for r in I.reconcile(h2, spark.createDataFrame([], FINDING), T3).collect()}
    assert set(h3) == {"a", "d", "h"} and not any(r.seen_in_latest for r in h3.values()) and h3["a"].status == "accepted"


def test_reconcile_stream_equals_batch(spark, tmp_path):
    first, second = runs()
    cols = [*I.MERGE_COLUMNS]
    for i, (batch, now) in enumerate(((first, T1), (second, T2))):
        df = spark.createDataFrame(rows(*batch), FINDING).select(cols).withColumn("analyzed_at", F.lit(now))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reports = jobs.read_folder(spark, str(tmp_path / "in"), jobs.REPORT_SCHEMA)
    out = str(tmp_path / "out")
    q = (jobs.reconcile_stream(reports).writeStream.outputMode("update").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, n: d.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).start())
    q.awaitTermination()
    all_rows = spark.read.parquet(out)
    last = all_rows.filter(F.col("n") == all_rows.agg(F.max("n")).first()[0])
    got = sorted((r.uid, r.status, r.seen_in_latest, r.first_detected_at) for r in last.collect())
    h1 = I.reconcile(spark.createDataFrame([], I.HISTORY_SCHEMA), spark.createDataFrame(rows(*first), FINDING), T1)
    h2 = I.reconcile(h1, spark.createDataFrame(rows(*second), FINDING), T2)
    assert got == sorted((r.uid, r.status, r.seen_in_latest, r.first_detected_at) for r in h2.collect())


def test_decision_stream_equals_batch(spark, tmp_path):
    schema = "book_id string, page_number int, uid string, status string, ts timestamp, seq bigint"
    data = [("b", 1, "a", "accepted", T1, 1), ("b", 1, "a", "dismissed", T2, 2), ("b", 1, "x", "fixed", T1, 3), ("b", 1, "a", "open", T1, 9)]
    for r in data:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_folder(spark, str(tmp_path / "in"), schema)
    q = jobs.decisions_to_table(stream, str(tmp_path / "table"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r.uid, r.status) for r in spark.read.parquet(str(tmp_path / "table" / f"batch={len(data) - 1}")).collect()}
    want = {(r.uid, r.decided) for r in R.latest_decisions(spark.createDataFrame(data, schema)).collect()}
    assert got == want == {("a", "dismissed"), ("x", "fixed")}


def test_stale_stream(spark, tmp_path):
    schema = "book_id string, page_number int, heartbeat_at timestamp, status string"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for batch in ([("b", 1, at(0), "processing"), ("b", 2, at(0), "processing")], [("b", 2, at(10), "done"), ("b", 3, at(100), "processing")], [("b", 9, at(101), "done")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stale_stream(jobs.read_folder(spark, str(tmp_path / "in"), schema))
    q = (stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
         .format("parquet").option("path", str(tmp_path / "out")).start())
    q.awaitTermination()
    assert [(r.book_id, r.page_number) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("b", 1)]


VIEW = "book_id string, page_number int, uid string, id bigint, quote string, suggestion string, xmin double, ymin double, xmax double, ymax double, box_source string, resolved boolean, ignored boolean"


def v(uid, id, page=4, x=1.0, src="ai", resolved=False, ignored=False):
    return ("b", page, uid, id, "q", "s", x, 1.0, x if x is None else x + 1, 2.0, src, resolved, ignored)


def test_geometry_and_ids(spark):
    cur = spark.createDataFrame([v("upper", 8, resolved=True), v("lower", 10, ignored=True), v("new", 11, src="unverified"), v("other", 12, page=5)], VIEW)
    late = spark.createDataFrame([v("lower", 1, x=70.0, src="pdf_text"), v("upper", 2, x=None, src="unverified"), v("removed", 3)], VIEW)
    got = {r.uid: r for r in R.apply_geometry(cur, late).collect()}
    assert got["lower"].xmin == 70 and got["lower"].ignored and got["upper"].xmin is None and got["upper"].resolved
    assert set(got) == {"upper", "lower", "new", "other"} and got["other"].xmin == 1
    inc = spark.createDataFrame([("b", 4, "new", 1), ("b", 4, "upper", 2), ("b", 4, "lower", 3)], "book_id string, page_number int, uid string, ord int")
    ids = {r.uid: r.id for r in R.stable_ids(inc, cur.filter("uid IN ('upper', 'lower')")).collect()}
    assert ids == {"new": 11, "upper": 8, "lower": 10}


def test_issue_map(spark):
    fs = spark.createDataFrame([(b, 3, u) for b in "abcde" for u in ("u1", "u2")], "book_id string, page_number int, uid string")
    m = spark.createDataFrame([("a", "u1", 1, 3), ("a", "u2", 2, 3), ("b", "gone", 1, 3), ("c", "u1", 1, 4), ("d", "u1", 1, 3), ("d", "u2", 1, 3), ("e", "u1", 1, 3), ("e", "u1", 2, 3)],
                              "book_id string, uid string, number bigint, page int")
    assert {r.book_id: r.accepted for r in R.validate_issue_map(m, fs).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
