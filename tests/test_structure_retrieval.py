"""Structure, contexts, retrieval, requests and plan shapes."""
import glob
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliocheck.functions import text as T
from foliocheck.operators import contexts as X, queue_state as Q, retrieval as R, structure as S
from foliocheck.sources import evidence as E, responses as A, sinks
from tests.test_rules import WORD_SCHEMA, word

SF = "/root/testdata/sf0.001"
PAGES = "book_id string, page_number int, text string, evidence_indexed boolean"


def test_partial_structure(spark):
    pages = spark.createDataFrame([("b", 2, "Contents\n1 Patterns 1\n2 Reasoning 10", False), ("b", 3, "Chapter 1: Patterns\nSource content", True)], PAGES)
    books = spark.createDataFrame([("b", 99)], "book_id string, page_count int")
    words = spark.createDataFrame([word("Chapter", 100, 100, 3)], WORD_SCHEMA)
    ch = S.infer_chapters(books, pages, words).orderBy("page").collect()
    assert [(c.name, c.start_page, c.end_page) for c in ch] == [("Front matter", 1, 2), ("Patterns", 3, 99)]
    df = spark.createDataFrame(ch)
    assert S.structure_status(books, df, pages).first().status == "partial"
    toc = S.printed_toc(pages).orderBy("number").collect()
    assert [(t.title, t.printed_page) for t in toc] == [("Patterns", 1), ("Reasoning", 10)]
    text = X.local_context(pages, df).filter("page_number = 3").first().context
    assert "1/97 chapter pages" in text and "PARTIAL CONTEXT" in text


def test_opener(spark):
    text = "Contents\nUnit 1: Patterns Recognition"
    pages = spark.createDataFrame([("b", 1, text, True), ("b", 2, "Unit 1: Patterns Recognition\nPatterns", True), ("b", 3, "Unit 1: Patterns Recognition", True)], PAGES)
    w = [word("Patterns", 150, 200, 1, line="1", offset=0), word("5", 800, 200, 1, line="2", offset=20), word("1", 60, 200, 1, line="3", offset=30)]
    for p in (2, 3):
        w += [word("Unit", 100, 100, p, line="1", offset=0), word("1:", 140, 100, p, line="1", offset=5)]
    w += [word("Patterns", 100, 200, 2, line="2", offset=40, height=30), word("body", 100, 400, 2, line="3", offset=60), word("text", 150, 400, 2, line="3", offset=65)]
    books = spark.createDataFrame([("b", 9)], "book_id string, page_count int")
    ch = S.infer_chapters(books, pages, spark.createDataFrame(w, WORD_SCHEMA)).orderBy("page").collect()
    assert [(c.name, c.start_page, c.end_page, c.confidence) for c in ch] == [("Front matter", 1, 1, 0.2), ("Patterns", 2, 9, 0.95)]
    assert ch[1].unit == "Unit 1: Patterns Recognition" and ch[1].number == 1


def test_inline_contents_and_expected_chapter(spark):
    pages = spark.createDataFrame([("b", 3, "Contents Chapter 1: Patterns ... 1 Chapter 2: Reasoning ... 10", True), ("b", 4, "x", True), ("b", 10, "x", True)], PAGES)
    t = S.printed_toc_inline(pages).collect()
    assert [(r.number, r.title, r.printed_page) for r in t] == [(1, "Patterns", 1), (2, "Reasoning", 10)]
    out = spark.createDataFrame([("b", 1, None, 1, "Unit 1: Thinking", None), ("b", 2, 1, 1, "Chapter 1: Patterns", 4), ("b", 3, 1, 2, "Chapter 2: Reasoning", 10), ("b", 4, None, 2, "Chapter 9: Far", 200)],
                                "book_id string, node_id int, parent_id int, ord int, title string, page int")
    flat = S.flatten_outline(out, spark.createDataFrame([("b", 25)], "book_id string, page_count int"))
    ch = flat.filter("name IS NOT NULL").select("book_id", "title", "number", "name", "page", "unit", F.lit("pdf").alias("page_numbering"), F.col("place").cast("bigint").alias("ord"))
    got = {r.page_number: (r.expected_chapter, r.expected_unit) for r in S.expected_chapter(pages, ch).collect()}
    assert got == {3: ("", ""), 4: ("Chapter 1: Patterns", "Unit 1: Thinking"), 10: ("Chapter 2: Reasoning", "Unit 1: Thinking")}


def test_refresh_contexts(spark):
    pages = spark.createDataFrame([("b", 1, "alpha", True), ("b", 2, "beta", True)], PAGES)
    books = spark.createDataFrame([("b", 2)], "book_id string, page_count int")
    ch = S.chapter_bounds(books, spark.createDataFrame([("b", 1, 1, "One", "", 0.8, "x")], "book_id string, page int, number bigint, name string, unit string, confidence double, source string"))
    src = X.chapter_source(pages, ch).first()
    ctx = spark.createDataFrame([("b", src.chapter_key, src.content_hash, "chapter-context-v2", "ready")], "book_id string, chapter_key string, content_hash string, analysis_version string, status string")
    same = X.refresh_contexts(ch, pages, ctx).first()
    changed = X.refresh_contexts(ch, pages.withColumn("text", F.concat("text", F.lit("!"))), ctx).first()
    assert (same.action, same.status) == ("kept", "ready")
    assert (changed.action, changed.status) == ("reset", "pending") and changed.content_hash != same.content_hash


def chunks(text, size=700):
    """The packing rule, spelled out."""
    clean = " ".join(text.split())
    if not clean:
        return []
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?।])\s+", clean):
        if cur and len(cur) + len(s) > size:
            out.append(cur.strip())
            cur = ""
        for o in range(0, len(s), size):
            part = s[o:o + size]
            if len(cur) + len(part) > size:
                out.append(cur.strip())
                cur = ""
            cur += (" " if cur else "") + part
    return out + ([cur.strip()] if cur else [])


def test_chunks_and_retrieval(spark):
    far = "Introductory source facts. " * 180 + "words Patterns is the printed heading near the lower page."
    texts = [far, "pattern " * 3000, "", "short. " * 150, "x" * 1500 + ". End."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.c for r in df.select("i", R.chunk_text(F.col("text")).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [chunks(t) for t in texts]
    q = spark.createDataFrame([(0, far, "heading words Patterns", ""), (1, texts[1], "pattern", "")], "i int, text string, message string, selected string")
    ctx = {r.i: r.context for r in R.retrieve_context(q).collect()}
    assert "words Patterns" in ctx[0] and 2800 < len(ctx[0]) <= 12000 and 2000 < len(ctx[1]) <= 12000


def test_ranked_findings(spark):
    fs = spark.createDataFrame([("b", "heading", 2, 3), ("b", "old-caption", 7, 4), ("b", "stem", 12, 6), ("b", "punctuation", 13, 6)], "book_id string, uid string, number bigint, page_number int")
    for c in ("type", "severity", "quote", "suggestion", "explanation", "status", "box_source"):
        fs = fs.withColumn(c, F.lit("-"))
    q = spark.createDataFrame([(1, "b", 6, "where are issue numbers 12, 13")], "query_id int, book_id string, page_number int, message string")
    got = [r.uid for r in R.rank_findings(q, fs).orderBy("place").collect()]
    assert got[:2] == ["stem", "punctuation"]
    refs = spark.createDataFrame([("issue number 12 , 13, 14",)], "m string").select(T.issue_refs(F.col("m")).alias("r")).first().r
    assert refs == [12, 13, 14]


def test_model_answers(spark):
    ok = '{"pageKind":"content","layoutNotes":"","issues":[{"type":"spelling","severity":"minor","quote":"a","suggestion":"b","explanation":"c","box_2d":[1,2,3,4]}]}'
    raws = [(ok, "STOP"), ("```json\n" + ok + "\n```", None), (ok, "MAX_TOKENS"), (ok.replace("minor", "huge"), "STOP"), ("{}", "STOP"), ("none", "STOP"), (ok.replace("[1,2,3,4]", "[1,2,3]"), "STOP")]
    got = A.parse_model_findings(spark.createDataFrame(raws, "raw string, finish_reason string")).collect()
    assert [r.reject is None for r in got] == [True, True, False, False, False, False, False]
    comp = [('{"answer":"Verified","observations":[]}', "STOP"), ('{"answer":"Verified","observations":[]}', "MAX_TOKENS"), ('{"answer":"x"}', "STOP")]
    got = A.parse_companion(spark.createDataFrame(comp, "raw string, finish_reason string")).collect()
    assert [r.answer for r in got] == ["Verified", None, None]


def test_requests(spark):
    pages = spark.createDataFrame([("b", 1, "done"), ("b", 2, "pending"), ("b", 3, "processing"), ("b", 4, "error")], "book_id string, page_number int, status string")
    req = spark.createDataFrame([(1, "reanalyze", "b", 1), (2, "reanalyze", "b", 2), (3, "reanalyze", "b", 3), (4, "reanalyze", "b", 9), (5, "resume", "b", None), (6, "reanalyze", "b", 1)],
                                "request_id int, kind string, book_id string, page_number int")
    got = {(r.request_id, r.page_number): r.outcome for r in Q.apply_requests(pages, req).collect()}
    assert got == {(1, 1): "pending", (2, 2): "conflict", (3, 3): "conflict", (4, 9): "missing", (5, 4): "pending", (6, 1): "conflict"}


def test_native_evidence(spark):
    df = spark.createDataFrame([("SUN " * 30,), ("native paragraph " * 30,)], "t string")
    got = [r.n for r in df.select(T.has_native_evidence(T.letters(F.col("t")), F.size(F.split(F.trim("t"), " "))).alias("n")).collect()]
    assert got == [False, True]


def test_rotated_run(spark):
    run = [("b", 1, 0, "Hello world", 10.0, 0.0, 0.0, 10.0, 50.0, 700.0, 55.0, 10.0), ("b", 2, 0, "Hello world", 0.0, 10.0, -10.0, 0.0, 50.0, 700.0, 55.0, 10.0)]
    df = spark.createDataFrame(run, "book_id string, page_number int, run_idx int, str string, a double, b double, c double, d double, e double, f double, width double, height double")
    df = df.selectExpr("*", "CAST(NULL AS DOUBLE) AS ascent", "CAST(NULL AS DOUBLE) AS descent", "600.0D AS viewport_width", "800.0D AS viewport_height", "array(1.0D,0.0D,0.0D,-1.0D,0.0D,800.0D) AS viewport")
    got = E.runs_to_words(df).orderBy("page_number", "w_no").collect()
    flat, upright = got[:2], got[2:]
    assert flat[0].xmin == pytest.approx(50 / 600 * 1000) and flat[1].xmax == pytest.approx(105 / 600 * 1000) and flat[0].text_end == 5
    assert upright[1].ymax < upright[0].ymax and upright[0].xmax - upright[0].xmin == pytest.approx(10 / 600 * 1000)


def test_csv_export(spark, tmp_path):
    f = spark.createDataFrame([("b", 1, 1, "spelling", "minor", 'say "hi"', "say hi", "why", 0.5, "accepted"), ("b", 2, 1, "x", "minor", "q", "s", "w", 0.5, "open")],
                              "book_id string, page_number int, seq bigint, type string, severity string, quote string, suggestion string, explanation string, confidence double, status string")
    sinks.write_export(f, str(tmp_path / "csv"))
    text = open(glob.glob(str(tmp_path / "csv/book_id=b/*.csv"))[0], encoding="utf-8").read()
    assert '"say ""hi"""' in text and text.count("\n") == 2 and "Page" in text.split("\n")[0]


def test_chapters_tile_books(spark):
    from foliocheck.plans import structure as PS
    from foliocheck.sources import corpus
    ch = PS.chapters(spark, SF)
    pages = S.assign_chapters(corpus.pages(spark, SF, text=False), ch)
    assert pages.count() == corpus.pages(spark, SF, text=False).count() == pages.select("book_id", "page_number").distinct().count()


PLANS = ["j1_assign_chapters", "j3_pair_toc_columns", "j7_locate_phrases", "j12_duplicate_pairs", "j13_merge_ocr_passes", "j14_words_in_bands", "j15_apply_geometry",
         "j18_validate_issue_map", "j19_scoped_knowledge", "w8_rank_findings", "d9_unit_label"]


@pytest.mark.parametrize("name", PLANS)
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_text_columns_are_pruned(spark):
    plan = entry.queries()["f1_book_status"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 4


OUTLINE = "book_id string, node_id int, parent_id int, ord int, title string, page int"


def test_outline_of_ten_thousand_bookmarks_equals_a_walk(spark):
    import random
    rng = random.Random(2)
    rows = [("b", i, None if i < 5 else rng.randrange(max(0, i - 400), i), rng.randint(0, 5), rng.choice(["Unit 1: A", "Unit 2: B", "Chapter 3: C", "Part", "", "Units"]), i % 70) for i in range(10_000)]
    rows += [("b", 20_000, 77_777, 1, "lost", 1), ("b", 20_001, 20_000, 1, "below lost", 1), ("b", 20_010, 20_012, 1, "ring", 1), ("b", 20_011, 20_010, 1, "ring", 1),
             ("b", 20_012, 20_011, 1, "ring", 1), ("b", 20_013, 20_012, 1, "below ring", 1), ("b", 20_020, 20_020, 1, "self", 1)]
    df = spark.createDataFrame(rows, OUTLINE)
    kids = {}
    for r in sorted(rows, key=lambda r: (r[3], r[1])):
        kids.setdefault(r[2], []).append(r)
    want, stack = [], [(list(reversed(kids[None])), "")]
    while stack:
        nodes, unit = stack.pop()
        if not nodes:
            continue
        r = nodes.pop()
        unit = r[4] if r[4].startswith("Unit ") else unit
        if r[4]:
            want.append((r[1], r[4], unit))
        stack += [(nodes, unit), (list(reversed(kids.get(r[1], []))), unit)]
    flat = S.flatten_outline(df, spark.createDataFrame([("b", 50)], "book_id string, page_count int")).orderBy("place").collect()
    assert [(r.node_id, r.title, r.unit) for r in flat] == want and all((r.page is None) == (r.node_id % 70 not in range(1, 51)) for r in flat)
    assert {(r.node_id, r.reject) for r in S.outline_rejects(df).collect()} == {
        (20_000, "no parent"), (20_001, "no parent"), *[(20_000 + i, "cycle") for i in (10, 11, 12, 13, 20)]}


def test_bookmarks_decide_over_headings_of_their_page(spark):
    books = spark.createDataFrame([("b", 30), ("none", 9)], "book_id string, page_count int")
    pages = spark.createDataFrame([("b", 4, "Chapter 1: Seen", True), ("b", 9, "Chapter 2: Later", True)], PAGES)
    out = spark.createDataFrame([("b", 1, None, 1, "Chapter 1: Marked", 4), ("b", 2, None, 2, "Chapter IV: Roman", 20), ("b", 3, None, 3, "Chapter 5: Beyond", 99)], OUTLINE)
    marks = S.bookmark_chapters(S.flatten_outline(out, books))
    got = [(r.book_id, r.start_page, r.end_page, r["name"], r.source) for r in S.infer_chapters(books, pages, None, marks).orderBy("book_id", "start_page").collect()]
    assert got == [("b", 1, 3, "Front matter", "front_matter"), ("b", 4, 8, "Marked", "bookmark"), ("b", 9, 19, "Later", "body_heading"), ("b", 20, 30, "Roman", "bookmark"),
                   ("none", 1, 9, "Unclassified content", "book_fallback")]


def test_one_start_per_chapter_number(spark):
    books = spark.createDataFrame([("b", 30), ("none", 9)], "book_id string, page_count int")
    starts = spark.createDataFrame([("b", 5, 1, "Old", "", 0.55, "x", 0), ("b", 4, 1, "One!", "", 0.92, "y", 1), ("b", 6, 1, "Late", "", 0.92, "y", 2), ("b", 4, 2, "Two", "", 0.82, "x", 3),
                                    ("b", 12, 0, "Appendix", "", 0.82, "x", 4), ("b", 13, 0, "Appendix", "", 0.82, "x", 5), ("b", 40, 7, "Beyond", "", 0.9, "x", 6), ("b", 20, None, "??", "", 0.9, "x", 7)],
                                   "book_id string, page int, number bigint, name string, unit string, confidence double, source string, ord bigint")
    best = S.best_start_per_number(starts, books)
    got = [(r.book_id, r.start_page, r.end_page, r.chapter_key) for r in S.numbered_bounds(books, best).orderBy("book_id", "start_page", "end_page", "chapter_key").collect()]
    assert got == [("b", 4, 4, "chapter-1-one"), ("b", 4, 11, "chapter-2-two"), ("b", 12, 12, "chapter-3-appendix"), ("b", 13, 19, "chapter-4-appendix"), ("b", 20, 30, "chapter-5-20"),
                   ("none", 1, 9, "chapter-1-unclassified-book-content")]
