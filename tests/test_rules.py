"""Text and layout rules on small pages."""
import pytest
from pyspark.sql import functions as F

from foliocheck.operators import findings as O, layout_rules as L, locate, rules

WORD_SCHEMA = ("book_id string, page_number int, word_idx int, str string, xmin double, ymin double, xmax double, ymax double, "
               "text_start int, text_end int, source string, confidence double, block_id string, paragraph_id string, line_id string, role string")


def word(str_, x, y, page=1, block="body", line="1", offset=0, height=15, role=None, source="ocr_text", conf=0.98, idx=None, wide=8):
    return ("b", page, offset if idx is None else idx, str_, float(x), float(y), float(x + wide * len(str_)), float(y + height), offset,
            offset + len(str_), source, conf, block, "1", line, role)


TEXTS = [
    ("my a Se :", None), ("my a\nSe :", None), ("Example 1 Activity 1 Example 2 Activity 2", None),
    ("Read the instruction on Page 65. 61", None),
    ("Here, the part will Complete the figure. Here, the part will Complete the figure.", None),
    ("Here, the part will Complete the figure. Here, the part will complete the figure.", None),
    ("Note : see", None), ("10 : 30", None), ("rat: and lion", None), ("Example 1 Example 3 Example 3", None), ("key :: value", None),
    ("see Page 400", 4), ("see Page 400", 390), ("see Page 400", None), ("plain text without defects. It goes on", None), ("https : x. e.g : y", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [("b", i, i, t, e, 99) for i, (t, e) in enumerate(TEXTS)]
    pages = spark.createDataFrame(rows, "book_id string, page_number int, doc_id bigint, text string, expected int, page_count int")
    out = {}
    for r in rules.lint_text(pages).orderBy("page_number", "seq").collect():
        out.setdefault(r.page_number, []).append(r)
        assert TEXTS[r.page_number][0][r.text_start:r.text_end] == r.quote
    return out


def brief(rs):
    return [(r.rule_id, r.quote, r.suggestion) for r in rs or []]


def test_heading_colon(found):
    assert [r.rule_id for r in found[0]] == ["heading_colon"]
    assert all("\n" not in r.quote for r in found[1])
    assert brief(found[6]) == [("heading_colon", "Note :", "Note: ")] and (found[6][0].text_start, found[6][0].text_end) == (0, 6)
    assert 7 not in found and 14 not in found


def test_conjunction_and_malformed(found):
    assert brief(found[8]) == [("conjunction_colon", "rat: and", "rat and")]
    assert brief(found[10]) == [("heading_colon", "key :", "key: "), ("malformed_colon", "key ::", "key:")]


def test_examples(found):
    assert 2 not in found
    assert [(r.severity, r.suggestion) for r in found[9]] == [("minor", "Example 2"), ("major", "Example 4")]


def test_page_numbers(found):
    assert 3 not in found and 12 not in found and 13 not in found
    assert brief(found[11]) == [("page_number", "Page 400", "Page 4")]


def test_modal_capital(found):
    assert len(found[4]) == 2 and found[4][0].text_start != found[4][1].text_start
    assert len(found[5]) == 1


def test_grounded_split(spark, found):
    r = found[0][0].asDict()
    df = spark.createDataFrame([{**r, "box_source": s} for s in ("unverified", "ocr_text")])
    ok, pending = O.partition_grounded(df)
    assert ok.count() == 1 and pending.first().box_source == "unverified"


def test_lowercase_heading(spark):
    def page(p, first):
        return [word(first, 100, 700, p, "h", "1", 0), word("Patterns", 146, 700, p, "h", "1", 6),
                word("find", 100, 750, p, "body", "2", 20), word("the", 140, 750, p, "body", "2", 25), word("pattern", 170, 750, p, "body", "2", 29)]
    rows = page(1, "words") + page(2, "Words") + [
        word("the", 100, 100, 3, "body", "1", 0), word("Patterns", 138, 100, 3, "body", "1", 4), word("find", 100, 150, 3, "body", "2", 20)]
    got = L.heading_findings(spark.createDataFrame(rows, WORD_SCHEMA)).collect()
    assert [(r.page_number, r.quote, r.suggestion, r.box_source) for r in got] == [(1, "words Patterns", "Words Patterns", "ocr_text")]


def test_transcript(spark):
    rows = [word("Words", 100, 100, block="heading", line="1", offset=0), word("Patterns", 150, 100, block="heading", line="1", offset=6),
            word("A", 100, 160, line="2", offset=15), word("sentence", 120, 160, line="2", offset=17)]
    assert L.layout_transcript(spark.createDataFrame(rows, WORD_SCHEMA)).first().transcript == "Words Patterns\nA sentence"


EXERCISE = [("Alphabet", 100, 100), ("pattern", 170, 100), ("Move", 100, 120), ("4", 140, 120), ("letters", 156, 120), ("forward,", 220, 120),
            ("then", 100, 138), ("1", 140, 138), ("letter", 156, 138), ("backward", 212, 138), ("E", 100, 170), ("I", 150, 170), ("H", 200, 170),
            ("L", 250, 170), ("K", 300, 170), ("+4", 125, 200), ("+1", 175, 200), ("+4", 225, 200), ("+1", 275, 200)]


def test_letter_steps(spark):
    rows = []
    for page in (1, 2, 3):
        for i, (s, x, y) in enumerate(EXERCISE):
            if page == 2 and s == "+1":
                s = "-1"
            if page == 3 and s == "backward":
                continue
            rows.append(word(s, x, y, page, offset=i * 10, height=12, source="pdf_text"))
    got = L.letter_step_findings(spark.createDataFrame(rows, WORD_SCHEMA)).orderBy("xmin").collect()
    assert [(r.page_number, r.quote, r.suggestion, r.xmin) for r in got] == [(1, "+1", "-1", 175.0), (1, "+1", "-1", 275.0)]


def test_unit_label(spark):
    def page(p, label):
        out, off = [], 0
        for i, s in enumerate(["Unit-1:", *label.split(), "Patterns"]):
            out.append(word(s, 100 + 90 * i if s != "Patterns" or i < 3 else 100, 150 if i < 3 else 300, p, offset=off, line=str(1 if i < 3 else 2)))
            off += len(s) + 1
        return out
    df = spark.createDataFrame(page(1, "Patterns Recognition") + page(2, "Pattern Recognition"), WORD_SCHEMA)
    got = locate.unit_label_findings(df).collect()
    assert [(r.page_number, r.quote, r.suggestion) for r in got] == [(1, "Patterns Recognition", "Pattern Recognition")]
