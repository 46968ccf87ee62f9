"""Runs of digits longer than any numeric type stop no job and hide no other row."""
import subprocess
import sys

from pyspark.sql import functions as F

from foliocheck.functions import digits, text as T
from foliocheck.operators import rules, structure

LONG, LONGER = "9" * 21, "1" * 41


def test_digit_text(spark):
    rows = [("7", "8"), ("009", "10"), ("0", "1"), ("19", "20"), ("99", "100"), ("129", "130"), (LONG, "1" + "0" * 21)]
    got = spark.createDataFrame(rows, "a string, b string").select("b", digits.successor(F.col("a")).alias("n"), (digits.order(F.col("b")) > digits.order(F.col("a"))).alias("up")).collect()
    assert all(r.b == r.n and r.up for r in got)


def test_rules_and_structure(spark):
    text = (f"Chapter 3: Light\nChapter {LONG}: Long\nUnit {LONGER}: Far\nExample {LONG}\nExample {LONG}\nExample 1{'0' * 21}\nExample 2{'0' * 40}\nPage {LONGER}\n")
    toc = f"Contents\n1 Light 12\n{LONG} Dark 14\n2 Sound {LONG}\n3 Heat 20\n"
    pages = spark.createDataFrame([("b", 1, 1, text, 1, 50), ("b", 2, 2, toc, 2, 50), ("b", 3, 3, "Example 1\nExample 1", 3, 50)],
                                  "book_id string, page_number int, doc_id long, text string, expected int, page_count int")
    found = rules.lint_text(pages).select("page_number", "rule_id", "quote", "suggestion", "explanation").collect()
    examples = [(r.quote, r.suggestion, r.explanation.split()[0]) for r in found if r.rule_id == "example_number" and r.page_number == 1]
    assert (f"Example {LONG}", f"Example 1{'0' * 21}", "Duplicate") in examples
    assert (f"Example 2{'0' * 40}", f"Example 1{'0' * 20}1", "Number") in examples and len(examples) == 2
    assert any(r.rule_id == "example_number" and r.page_number == 3 for r in found)
    assert any(r.rule_id == "page_number" and r.page_number == 1 and LONGER in r.explanation for r in found)
    assert [r.number for r in structure.heading_lines(pages).collect()] == [3]
    assert structure.body_headings(pages).count() >= 0 and structure.printed_toc_inline(pages).count() >= 0
    assert sorted(r.title for r in structure.printed_toc(pages).collect()) == ["Heat", "Light"]


def test_chat_refs(spark):
    refs = spark.createDataFrame([(f"issues {LONG}, 4 and 5",)], "q string").select(T.issue_refs(F.col("q")).alias("r")).first().r
    assert refs == [4, 5]


def test_workers_get_the_package_from_the_session(tmp_path):
    """A query with Python workers runs from another folder, without a path of its own."""
    code = ("import sys; sys.path.insert(0, %r)\nfrom foliocheck.session import local_session\nimport __spark_entry__ as e\n"
            "spark = local_session(cores='2', memory='4g')\nprint('rows', e.queries()['r4_flatten_outline'](spark, '/root/testdata/sf0.001').count())\n")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code % root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
