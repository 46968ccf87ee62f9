"""Queries of the text rules."""
from pyspark.sql import functions as F

from foliocheck.operators import rules
from foliocheck.sources import corpus

OUT = ["book_id", "page_number", "seq", "rule_id", "type", "severity", "quote", "suggestion",
       "text_start", "text_end", "confidence"]


def _template(rule_id):
    rule = [r for r in rules.TEXT_RULES if r.rule_id == rule_id]

    def run(spark, sf_dir):
        m = rules.scan(corpus.pages(spark, sf_dir), [(rule[0].rule_id, rule[0].pattern, rule[0].literal)])
        return rules.rule_findings(m, rule).select(OUT)
    return run


def expected_pages(spark, sf_dir):
    counts = corpus.books(spark, sf_dir).select("book_id", "page_count")
    return (corpus.pages(spark, sf_dir).join(counts, "book_id")
            .withColumn("expected", F.col("page_number")))


def page_number_sequence(spark, sf_dir):
    pages = expected_pages(spark, sf_dir)
    m = rules.scan(pages, rules.EXTRA_SCANS[:1])
    return rules.page_number_findings(pages, m).select(*OUT, "explanation")


def example_numbering(spark, sf_dir):
    m = rules.scan(corpus.pages(spark, sf_dir), rules.EXTRA_SCANS[1:])
    return rules.rule_findings(m, []).select(*OUT, "explanation")


QUERIES = {
    "d1_heading_colon": _template("heading_colon"),
    "d2_conjunction_colon": _template("conjunction_colon"),
    "d3_page_number_sequence": page_number_sequence,
    "d4_example_numbering": example_numbering,
    "d5_malformed_colon": _template("malformed_colon"),
    "d6_modal_capital": _template("modal_capital"),
}
