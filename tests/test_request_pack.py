"""Earlier findings in a request are whole, or counted as left out."""
import json

from pyspark.sql import functions as F

from foliocheck.sources import responses


def test_prior_findings_stay_json(spark):
    pages = spark.createDataFrame([("b", 1, "text"), ("b", 2, "text")], "book_id string, page_number int, text string")
    found = spark.createDataFrame([("b", 1, i, f"u{i}", "spelling", "q" * 50, "s", "open") for i in range(10)],
                                  "book_id string, page_number int, seq long, uid string, type string, quote string, suggestion string, status string")
    none = spark.createDataFrame([], "book_id string, page_number int, context string, knowledge string")
    pack = {r.page_number: r for r in responses.build_request_pack(pages, found, none.drop("knowledge"), none.drop("context"), F.lit("x"), prior_chars=400).collect()}
    kept = json.loads(pack[1].prior)
    assert 0 < len(kept) < 10 and len(kept) + pack[1].prior_left_out == 10 and len(pack[1].prior) <= 400
    assert pack[2].prior == "[]" and pack[2].prior_left_out == 0
