"""Recogniser tables, phrase location and grounding."""
from pyspark.sql import functions as F

from foliocheck.functions import text as T
from foliocheck.operators import ground as G, locate as L, streams
from foliocheck.sources import evidence as E
from tests.test_rules import WORD_SCHEMA, word

FINDING = ("uid string, book_id string, page_number int, seq bigint, type string, severity string, quote string, suggestion string, explanation string, "
           "xmin double, ymin double, xmax double, ymax double, box_source string, source string, text_start int, text_end int, confidence double, status string")


def finding(uid, page, quote, suggestion, type="examples", source="ai", start=None, box=(0, 0, 1000, 1000), box_source="unverified"):
    return (uid, "b", page, 1, type, "minor", quote, suggestion, "", *[float(v) for v in box], box_source, source, start, None, 0.9, "open")


def native(text, page, x=100, y=100, gap=8, start=0):
    out, off = [], start
    for s in text.split(" "):
        out.append(word(s, x, y, page, offset=off, source="pdf_text", wide=8, block=None, line=None))
        x, off = x + 8 * len(s) + gap, off + len(s) + 1
    return out


def test_ocr_table(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    lines = [head, "5\t1\t1\t1\t1\t1\t100\t200\t200\t40\t98\tComplete", "5\t1\t1\t1\t1\t2\tNaN\t0\t10\t20\t99\tbroken",
             "5\t1\t1\t1\t1\t3\t20\t20\t20\t20\t10\tuncertain", "5\t1\t1\t1\t1\t4\t400\t200\t100\t40\t90\ttab\tword"]
    df = spark.createDataFrame([("b", 1, i, l, 2000, 1000) for i, l in enumerate(lines)] + [("b", 2, 1, lines[1], 0, 0)],
                               "book_id string, page_number int, line_no int, line string, width int, height int")
    got = {r.str: r for r in E.read_ocr_tsv(df).collect()}
    w = got["Complete"]
    assert (w.xmin, w.ymin, w.xmax, w.ymax, w.text_start, w.text_end, w.confidence) == (50, 200, 150, 240, 0, 8, 0.98)
    assert (w.block_id, w.paragraph_id, w.line_id) == ("1", "1", "1")
    assert set(got) == {"Complete", "uncertain", "tab word"} and got["uncertain"].uncertain and got["tab word"].text_start == 9


def test_tokens(spark):
    r = spark.createDataFrame([("scriptures¹", "ﬁne A1b2")], "a string, b string").select(
        T.location_tokens(F.col("a")).alias("a"), T.location_tokens(F.col("b")).alias("b")).first()
    assert r.a == ["scriptures", "1"] and r.b == ["fine", "a", "1", "b", "2"]


def test_edits(spark):
    cases = [("cat", "cart"), ("a b", "a b"), ("", "x"), ("figure.", "figures."), ("+1", "−1"), ("aaa", "aa")]
    df = spark.createDataFrame(cases, "q string, s string").select(T.clean_text(F.col("q")).alias("q"), T.clean_text(F.col("s")).alias("s"))
    got = [r.e for r in df.select(T.minimal_edit(F.col("q"), F.col("s")).alias("e")).collect()]
    assert [None if e is None else tuple(e) for e in got] == [("", "r", 2), None, None, ("", "s", 6), ("+", "-", 0), ("a", "", 2)]


def test_grounding(spark):
    words = (native("Example 2 and Example 2", 1) + native("3 of 99 and", 3) + native("99", 3, y=950, start=60) + native("will complete the", 4)
             + native("cat and dog", 5) + native("Note :", 6, gap=4) + native('"word"', 7))
    fs = [finding("two", 1, "Example 2", "Example 3"), finding("wrong-offset", 1, "Example 2", "Example 3", start=90),
          finding("none", 2, "anything here", "x"), finding("num", 3, "99", "Page 3", "page_number", "linter", 60),
          finding("model-num", 3, "99", "98", "number"), finding("image", 4, "a picture", "", "image", box=(1, 2, 30, 40), box_source="ai"),
          finding("case", 4, "will Complete the", "will complete the", "typography"), finding("fixed", 5, "cat: and dog", "cat and dog", "punctuation"),
          finding("colon", 6, "Note :", "Note:", "punctuation", "linter", 0), finding("quotes", 7, "“word”", '"word"', "punctuation")]
    got = {r.uid: r for r in G.ground_findings(spark.createDataFrame(fs, FINDING), spark.createDataFrame(words, WORD_SCHEMA)).collect()}
    assert len(got) == len(fs)
    for uid in ("two", "wrong-offset", "none", "model-num", "case", "fixed", "quotes"):
        assert got[uid].box_source == "unverified", uid
    assert got["case"].text_start is None
    assert got["num"].box_source == "pdf_text" and got["num"].ymin == 950
    assert got["image"].box_source == "ai" and got["image"].xmin == 1
    assert got["colon"].box_source == "pdf_text" and got["colon"].text_end == 6


def test_copies(spark):
    words = native("the part will Complete the figure", 1) + native("the part will Complete the figure", 1, y=300, start=40)
    f = finding("c", 1, "will Complete", "will complete", "typography", "linter", 9)
    out = G.ground_findings(spark.createDataFrame([f], FINDING), spark.createDataFrame(words, WORD_SCHEMA)).orderBy("ymin").collect()
    assert [(r.text_start, r.ymin, r.status) for r in out] == [(9, 100.0, "open"), (49, 300.0, "open")] and out[0].uid == "c"


def test_columns_and_jumps(spark):
    rows, off = [], 0
    for y, left, right in ((100, "find the", "other words"), (120, "pattern in", "stand here"), (140, "each row", "as well")):
        for x, part in ((100, left), (600, right)):
            for i, s in enumerate(part.split()):
                rows.append(word(s, x + 70 * i, y, 1, offset=off))
                off += len(s) + 1
    rows += [word("Find", 100, 100, 2, offset=0), word("missing", 600, 100, 2, offset=5)]
    words = streams.streamed_words(spark.createDataFrame(rows, WORD_SCHEMA))
    q = spark.createDataFrame([("a", "b", 1, "find the pattern in each row"), ("z", "b", 2, "Find missing")], "fid string, book_id string, page_number int, quote string")
    got = L.locate_phrases(q, words).collect()
    assert [r.fid for r in got] == ["a"] and got[0].xmax < 500 and got[0].source == "ocr_text"


def test_fuzzy_against_brute_force(spark):
    import itertools
    text = "alpha betas gamma delta epsilon alpha beta gamma extraordinarily complicated constructions"
    quotes = ["alpha beta gamma", "gamma delta epsilom", "extraordinarely complicatad constructiens", "alpha delta", "betas gamma"]
    df = spark.createDataFrame([(str(i), "b", 1, q) for i, q in enumerate(quotes)], "fid string, book_id string, page_number int, quote string")
    got = {(r.fid, r.text_start) for r in L.locate_phrases(df, spark.createDataFrame(native(text, 1), WORD_SCHEMA), fuzzy=True).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        return row[-1]
    toks = text.split()
    starts = list(itertools.accumulate([0] + [len(t) + 1 for t in toks]))
    want = set()
    for i, q in enumerate(quotes):
        qt = q.split()
        for s in range(len(toks) - len(qt) + 1):
            sims = [1 - lev(a, b) / max(len(a), len(b)) for a, b in zip(qt, toks[s:])]
            if sum(sims) / len(sims) >= 0.9 and min(sims) >= 0.8:
                want.add((str(i), starts[s]))
    assert got == want and want


def test_merge_passes(spark):
    base = [word("a", 100, 100, idx=1)]
    extra = [word("a", 101, 100, idx=1), word("bb", 200, 100, idx=2), word("bb", 202, 100, idx=3), word("bb", 204, 100, idx=4), word("zz", 500, 500, idx=5)]
    got = E.merge_ocr_passes(spark.createDataFrame(base, WORD_SCHEMA), spark.createDataFrame(extra, WORD_SCHEMA), "sparse").orderBy("word_idx").collect()
    assert [(r.word_idx, r.text_start) for r in got] == [(2, 2), (5, 5)] and got[0].block_id == "sparse:body"


def two_columns(page, rows):
    out, off = [], 0
    for y, left, right in rows:
        for x, part in ((100, left), (600, right)):
            for i, s in enumerate(part.split()):
                out.append(word(s, x + 70 * i, y, page, offset=off))
                off += len(s) + 1
    return out


def test_findings_ground_down_a_column(spark):
    words = spark.createDataFrame(two_columns(1, [(100, "find the", "other words"), (120, "pattern in", "stand here"), (140, "each row", "as well")]), WORD_SCHEMA)
    fs = [finding("down", 1, "find the pattern in each row", "find a pattern in each row"), finding("across", 1, "the other words stand", "the other word stands")]
    got = {r.uid: r for r in G.ground_findings(spark.createDataFrame(fs, FINDING), words).collect()}
    assert got["down"].box_source == "ocr_text" and got["down"].xmax < 500 and got["across"].box_source == "unverified"
    stored = L.locate_phrases(spark.createDataFrame([("a", "b", 1, "find the pattern in each row")], "fid string, book_id string, page_number int, quote string"), words, all_orders=False)
    assert stored.collect() == []


def test_letter_steps_prove_the_place_of_a_signed_number(spark):
    words = spark.createDataFrame(native("+1 and +1 and +1", 1), WORD_SCHEMA)
    steps = [("b", 1, "+1", "-1", 100.0 + 80 * i, 100.0, 116.0 + 80 * i, 110.0, "pdf_text", at, at + 2) for i, at in enumerate((7, 14))]
    steps = spark.createDataFrame(steps, "book_id string, page_number int, quote string, suggestion string, xmin double, ymin double, xmax double, ymax double, box_source string, text_start int, text_end int")
    fs = spark.createDataFrame([finding("s", 1, "+1", "−1", "number"), finding("other", 1, "+1", "+2", "number"), finding("placed", 1, "+1", "-1", "number", "linter", 0)], FINDING)
    rows = G.ground_findings(G.with_letter_steps(fs, steps), words).collect()
    by = {r.uid: r for r in rows}
    assert sorted(r.text_start for r in rows if r.uid not in ("other", "placed")) == [7, 14] and by["s"].text_start == 7 and by["s"].box_source == "pdf_text"
    assert by["other"].box_source == "unverified" and by["placed"].text_start == 0 and len(rows) == 4


def test_orders_of_a_page_equal_a_plain_walk(spark):
    import random
    rng, rows = random.Random(5), []
    for page in range(1, 13):
        for i in range(rng.randint(1, 40)):
            x, y = rng.choice([60, 90, 300, 520, 700]) + rng.randint(0, 40), rng.randint(0, 20) * 13 + rng.randint(-3, 3)
            rows.append(word("w", x, y, page, offset=i, block=rng.choice([None, "1", "2"])))
    df = spark.createDataFrame(rows, WORD_SCHEMA)
    got = {}
    for r in streams.reading_streams(df).orderBy("stream", "ord").collect():
        got.setdefault(r.page_number, {}).setdefault(r.stream, []).append(r.word_idx)
    pages = {}
    for r in df.collect():
        pages.setdefault(r.page_number, []).append(r)

    def lines(ws):
        left, out = sorted(ws, key=lambda w: (w.ymin, w.xmin, w.word_idx)), []
        while left:
            lead = left[0]
            height = lambda w: w.ymax - w.ymin
            level = [w for w in left if abs(w.ymin + height(w) / 2 - lead.ymin - height(lead) / 2) <= max(3, 0.55 * min(height(w), height(lead)))]
            out += sorted(level, key=lambda w: (w.xmin, w.word_idx))
            left = [w for w in left if w not in level]
        return out
    for page, ws in pages.items():
        ws = sorted(ws, key=lambda w: w.word_idx)
        want = [ws, lines(ws)]
        groups = {}
        for w in ws:
            if w.block_id:
                groups.setdefault((w.block_id, w.paragraph_id), []).append(w)
        want += [lines(g) for g in groups.values()]
        have = list(got[page].values())
        assert have[:len(want)] == [[w.word_idx for w in o] for o in want]
        for left, right in zip(have[len(want)::2], have[len(want) + 1::2]):
            if len(left) + len(right) == len(ws):
                assert sorted(left + right) == [w.word_idx for w in ws]
