"""Plans and partitions whose cost must grow with the input and no faster."""
from pyspark.sql import functions as F

from foliocheck.functions import text as T
from foliocheck.operators import contexts as X, identity as I, layout_rules as LR, locate as L, spatial
from foliocheck.plans import layout, locate, review, structure
from foliocheck.sources import corpus, evidence as E, findings
from tests.test_ground import FINDING
from tests.test_identity import T1, T2, f, rows

SF = "/root/testdata/sf0.001"


def filters(df):
    """The conditions of a plan's filters, each on one line."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().replace("\n", " ")
    return [part.split("+- ")[0] for part in plan.split("Filter ")[1:]]


def test_runs_to_words_lays_out_each_word_once(spark):
    """A filter on the box must not repeat the geometry behind it."""
    words = E.runs_to_words(corpus.runs(spark, SF))
    assert not [f for f in filters(words) if "viewport" in f or "adv" in f]
    assert words.count() > 0


def test_runs_without_size_are_left_out(spark):
    cols = ["book_id", "page_number", "run_idx", "str", "a", "b", "c", "d", "e", "f", "width", "height", "ascent", "descent", "viewport_width", "viewport_height", "viewport"]
    run = ["b", 1, 0, "two words", 10.0, 0.0, 0.0, 10.0, 50.0, 50.0, 40.0, 10.0, None, None, 600.0, 800.0, [1.0, 0.0, 0.0, -1.0, 0.0, 800.0]]
    flat = list(run)
    flat[2:4], flat[4] = [1, "flat"], 0.0
    types = ("book_id string, page_number int, run_idx int, str string, a double, b double, c double, d double, e double, f double, width double, height double, "
             "ascent double, descent double, viewport_width double, viewport_height double, viewport array<double>")
    assert len(types.split(", ")) == len(cols)
    got = E.runs_to_words(spark.createDataFrame([run, flat], types)).orderBy("text_start").collect()
    assert [(r["str"], r["text_start"], r["text_end"]) for r in got] == [("two", 0, 3), ("words", 4, 9)]


def test_read_ocr_tsv_splits_each_line_once(spark):
    """A filter on a field must not split the line again."""
    words = E.read_ocr_tsv(corpus.ocr_lines(spark, SF))
    assert not [f for f in filters(words) if "concat_ws" in f or "try_cast" in f or "array_join" in f]
    assert words.count() > 0


def test_read_ocr_tsv_leaves_out_short_and_sizeless_rows(spark):
    good = "5\t1\t2\t3\t4\t1\t100\t50\t40\t10\t90\tword"
    rows = [("b", 1, 0, 200, 100, good), ("b", 1, 1, 0, 100, good), ("b", 1, 2, 200, 100, good.rsplit("\t", 1)[0]),
            ("b", 1, 3, 200, 100, good.replace("90\tword", "20\tdim")), ("b", 1, 4, 200, 100, good.replace("word", "last")), ("b", 1, 5, 200, 100, good.replace("\t40\t", "\tNaN\t"))]
    got = E.read_ocr_tsv(spark.createDataFrame(rows, "book_id string, page_number int, line_no int, width int, height int, line string")).orderBy("line_no").collect()
    assert [(r["line_no"], r["str"], r["uncertain"], r["text_start"], r["text_end"]) for r in got] == [
        (0, "word", False, 0, 4), (3, "dim", True, None, None), (4, "last", False, 5, 9)]


def test_merging_takes_whole_pages_from_small_batches(spark):
    """Many pages are decided at a time, also where a batch ends inside a page; no page pays for a group of its own."""
    pages = 30
    data = [r for p in range(pages) for r in rows(f(uid=f"a{p}", page_number=p), f(uid=f"b{p}", page_number=p, text_start=None, box_source="unverified"),
                                                  f(uid=f"c{p}", page_number=p), f(uid=f"d{p}", page_number=p, xmin=101.0))]
    df = spark.createDataFrame(data, FINDING)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        merged = I.merge_findings(df)
        plan = merged._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "FlatMapGroupsInArrow" not in plan
        assert sorted(r.uid for r in merged.collect()) == sorted(f"{k}{p}" for k in "ab" for p in range(pages))
        old = merged.withColumns({"seen_in_latest": F.lit(True), "first_detected_at": F.lit(T1), "last_detected_at": F.lit(T1)})
        got = {r.uid: r.seen_in_latest for r in I.reconcile(old, df.filter("uid LIKE 'd%'").withColumn("uid", F.concat("uid", F.lit("x"))), T2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {f"{k}{p}": k == "a" for k in "ab" for p in range(pages)}


def test_two_runs_share_one_scan(spark, monkeypatch):
    """The findings of a second run come from those of the first, not from a second scan of the texts."""
    scans = []
    real = findings.findings
    monkeypatch.setattr(findings, "findings", lambda *a: scans.append(a) or real(*a))
    for query in (review.f9, review.s1, review.s2):
        scans.clear()
        query(spark, SF)
        assert len(scans) == 1


def test_texts_are_cut_by_their_size(spark, monkeypatch):
    """More text makes more partitions, not larger ones, and adaptive execution does not put them together."""
    monkeypatch.setattr(corpus, "CHARS_PER_PARTITION", 10_000)
    docs = corpus.table(spark, SF, "documents")
    wanted = docs.agg(F.sum("n_chars")).first()[0] // 10_000
    assert wanted > int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_task = corpus.page_words(spark, SF).groupBy(F.spark_partition_id()).count()
    assert corpus.text_by_page(spark, SF).rdd.getNumPartitions() > wanted
    assert per_task.count() > wanted // 3


def test_page_rows_hold_the_words_laid_out_by_hand(spark):
    """Blanks at the ends, empty lines, letters of several bytes, a text without words and one that is null."""
    texts = ["é  𝒳y\n\n z ", "", None, "Chapter 1: A\nb"]
    rows = spark.createDataFrame([("b", i + 2, 100 * (i + 1) + 5, t) for i, t in enumerate(texts)], "book_id string, page_number int, doc_id long, text string")
    got = {r.page_number: [(w.str, w.text_start, w.text_end, w.xmin, round(w.ymax - w.ymin, 6)) for w in r.words] for r in corpus.pages_of(rows).collect()}
    assert got == {2: [("é", 0, 1, 60.0, 12.0), ("𝒳y", 3, 5, 82.5, 12.0), ("z", 8, 9, 67.5, 12.0)],
                   5: [("Chapter", 0, 7, 60.0, 24.0), ("1:", 8, 10, 120.0, 24.0), ("A", 11, 12, 142.5, 24.0), ("b", 13, 14, 60.0, 12.0)]}


def test_quotes_meet_texts_before_words_are_made(spark):
    """Neither words nor reading orders move between tasks, and no rule over all pages writes the words."""
    plan = locate.j7_orders(spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("ArrowEvalPython [_distinct_orders")]
    between = plan[plan.index("ArrowEvalPython [_distinct_orders"):plan.index("ArrowEvalPython [place_words")]
    assert "Exchange" not in between and "SortMergeJoin" not in between
    assert "words" not in "".join(part for part in above.split("\n") if "Exchange" in part)


def test_lint_writes_only_the_pages_of_a_rule(spark, monkeypatch):
    written = []
    real = L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append(real(df)) or written[-1])
    found = locate.lint_pages(spark, SF)
    pages = corpus.word_pages(spark, SF).count()
    assert len(written) == 1 and 0 < written[0].count() < pages / 4
    assert found.filter("rule_id IN ('unit_label', 'letter_steps', 'lowercase_heading')").select("rule_id").distinct().count() == 3


def test_openers_lay_out_only_pages_with_large_words(spark):
    """Page rows and word rows agree, and word rows are made only of pages that can hold an opener."""
    pages, rows = corpus.word_pages(spark, SF), corpus.words(spark, SF)
    tall = "y <= 330 AND height >= median * 1.4"
    cols = ["book_id", "page_number", "text", "median", "height", "first"]
    want = sorted(map(tuple, LR.page_lines(rows).filter(tall).select(cols).collect()))
    assert want and sorted(map(tuple, LR.page_lines(pages, large=(1.4, 330)).filter(tall).select(cols).collect())) == want
    assert LR._pages_with_large(pages, 1.4, 330).select("book_id", "page_number").distinct().count() < pages.count() / 2


def test_passes_are_merged_where_the_words_are(spark):
    """Only page texts move; no page pays for a group of its own."""
    plan = layout.j13(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Join" not in plan and "Window" not in plan
    assert plan.count("Exchange") == 1 and "words" not in "".join(part for part in plan.split("\n") if "Exchange" in part)


def test_merged_passes_equal_rules_word_by_word(spark, monkeypatch):
    """Crowded pages, equal boxes, boxes without area, beyond the page or as high as it, pages of one pass only; also where few pairs are compared at a time."""
    import random
    monkeypatch.setattr(spatial, "PAIRS", 7)
    r = random.Random(3)

    def some_words(page, n):
        out = []
        for i in r.sample(range(500), n):
            x, y, w, h = r.choice([0.0, 40.0, 100.0, 990.0, r.uniform(-60, 1000)]), r.choice([10.0, 12.0, r.uniform(0, 40)]), r.choice([0.0, 30.0, 31.0, r.uniform(1, 90)]), r.choice([10.0, 11.0, 0.4])
            out.append(("b", page, i, r.choice(["a", "\U0001d4b3y", "", "long"]), x, y, x + w, 1000.0 if r.random() < 0.02 else y + h, r.choice(["1", None])))
        return out
    base = [w for p in range(1, 12) for w in some_words(p, 9)]
    extra = [w for p in range(3, 14) for w in some_words(p, 60 if p < 8 else 4)]

    def covers(a, b):
        shared = max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))
        area = lambda v: (v[6] - v[4]) * (v[7] - v[5])
        return shared / max(1.0, min(area(a), area(b))) > 0.65
    want = []
    for page in range(3, 14):
        fixed, kept = [w for w in base if w[1] == page], []
        end = sum(len(w[3]) + 1 for w in fixed) or 1
        for w in sorted((w for w in extra if w[1] == page), key=lambda w: w[2]):
            if not any(covers(w, o) for o in fixed + kept):
                kept.append(w)
                want.append((page, w[2], w[3], end, end + len(w[3]), f"x:{w[8] or ''}"))
                end += len(w[3]) + 1
    types = "book_id string, page_number int, word_idx int, str string, xmin double, ymin double, xmax double, ymax double, block_id string"
    got = E.merge_ocr_passes(spark.createDataFrame(base, types), spark.createDataFrame(extra, types), "x").select("page_number", "word_idx", "str", "text_start", "text_end", "block_id")
    assert sorted(map(tuple, got.collect())) == want and 100 < len(want) < len(extra)
    arrays = [[E.pa.array([[w[c] for w in side]]) for c in (4, 5, 6, 7)] for side in (base, sorted(extra, key=lambda w: w[2]))]
    in_chunks = spatial.covered_words(*arrays, E.pa.array([sorted(w[2] for w in extra)]), 0.65)
    monkeypatch.setattr(spatial, "PAIRS", 10**6)
    assert (in_chunks == spatial.covered_words(*arrays, E.pa.array([sorted(w[2] for w in extra)]), 0.65)).all() and in_chunks.any()


def test_headings_are_found_where_the_words_are(spark):
    """No word moves between tasks, and the short lines of page rows are the lines of word rows."""
    pages, rows = corpus.word_pages(spark, SF), corpus.words(spark, SF)
    plan = LR.heading_findings(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Window" not in plan
    cols = ["book_id", "page_number", "text", "first", "y", "height", "x", "xmin", "xmax", "ymax", "n_words", "weak", "banner", "all_ocr", "text_start", "text_end", "median", "block_words"]
    ocr = corpus.ocr_words(spark, SF).withColumn("role", F.when(F.col("text_start") < 20, "heading"))
    for words, page_rows in ((rows, pages), (ocr, ocr), (ocr.withColumn("str", F.when(F.col("word_idx") % 3 > 0, F.col("str")).otherwise("")), None)):
        want = LR.page_lines(words).filter(f"n_words <= {LR.SHORT}").select(cols)
        got = LR.short_lines(words if page_rows is None else page_rows).select("book_id", "page_number", "median", F.inline("lines")).select(cols)
        if page_rows is None:
            assert got.filter(f"n_words > {LR.SHORT}").count() > 0
            got = got.filter(f"n_words <= {LR.SHORT}")
        assert want.count() == got.count() > 100 and want.exceptAll(got).count() == 0


def test_bands_meet_pages_before_words_are_made(spark):
    """No word moves between tasks; page rows give the words that word rows give, once each where bands overlap."""
    plan = layout.j14(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "words" not in "".join(part for part in plan.split("\n") if "Exchange" in part or "Join" in part)
    assert plan.index("ArrowEvalPython [place_words") < min(plan.index(j) for j in ("SortMergeJoin", "BroadcastHashJoin") if j in plan)
    bands = corpus.pages(spark, SF, text=False).filter("page_number % 5 > 0").selectExpr(
        "book_id", "page_number", "explode(array(30D, 60D, 300D)) AS top", "top + 100 AS bottom", "50D AS left", "CAST(300 + page_number * 10 AS DOUBLE) AS right")
    cols = ["book_id", "page_number", "word_idx", "str", "role"]
    want = E.words_in_bands(corpus.ocr_words(spark, SF), bands).select(cols)
    for words in (corpus.ocr_word_pages(spark, SF), lambda beside: corpus.ocr_word_pages(spark, SF, beside), lambda beside: corpus.ocr_words_beside(spark, SF, beside)):
        got = E.words_in_bands(words, bands).select(cols)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def test_memories_are_folded_in_bounded_partitions(spark, monkeypatch):
    """Parts move once, into partitions by their number, and nothing is put together or moved after that."""
    monkeypatch.setattr(X, "PARTS_PER_PARTITION", 10)
    folded = structure.f10_fold(spark, SF)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("REPARTITION_BY_NUM")]
    n = corpus.table(spark, SF, "documents").count() // 10 + 1
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions")) and above.count("Exchange") == 1
    assert folded.rdd.getNumPartitions() == n


def test_beginning_of_squashed_text(spark):
    texts = [None, "", "  a  b ", "x" * 30, " " * 100 + "ab  c", "a " * 30, "ab\t\n" * 9, "a" + " " * 60 + "b" * 9, "a" * 5 + " " * 16]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 5, 10):
        assert rows.filter(~T.squash_head(F.col("t"), n).eqNullSafe(F.substring(T.squash(F.col("t")), 1, n))).count() == 0


def test_large_words_are_found_without_a_sort_for_each_word(spark):
    """The median of a page is no part of a test of its words, and pages at the limit stay."""
    from foliocheck.operators import layout_rules as LR
    word = "struct<word_idx:int,str:string,xmin:double,ymin:double,xmax:double,ymax:double,text_start:int,text_end:int>"
    row = lambda i, y, h: (i, f"w{i}", 10.0 * i, float(y), 10.0 * i + 8, float(y + h), 3 * i, 3 * i + 2)
    small = [row(i, 50 + 20 * i, 10) for i in range(1, 6)]
    rows = [("b", 1, [row(0, 40, 14), *small]), ("b", 2, [row(0, 40, 13), *small]), ("b", 3, [row(0, 331, 30), *small]), ("b", 4, [row(0, 300, 15)]),
            ("b", 5, [row(0, 40, 0), row(1, 60, -1)])]
    pages = spark.createDataFrame(rows, f"book_id string, page_number int, words array<{word}>")
    lines = LR.page_lines(pages, large=(1.4, 330))
    assert {(r.page_number, r.median) for r in lines.collect()} == {(1, 10.0)}
    assert "exists(" not in lines._jdf.queryExecution().optimizedPlan().toString()
