"""The findings table of the corpus: rule findings plus the findings of a remote model."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliocheck.operators import rules
from foliocheck.session import cut_lineage
from foliocheck.sources import corpus, seeds


def model_findings(pages: DataFrame) -> DataFrame:
    cols = corpus._exprs(seeds.model_columns())
    return pages.filter(seeds.MODEL_PAGES).select("book_id", "page_number", "doc_id", *cols).select(rules.FINDING_COLUMNS)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings. The texts are scanned once and the matches written: most queries read them several times."""
    pages = corpus.pages(spark, sf_dir)
    rows = rules.lint_text(pages).unionByName(model_findings(pages))
    return cut_lineage(rules.with_uid(rows.withColumn("status", F.expr(seeds.FINDING_STATUS))))


def exercise_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings seeded on exercise pages, with the columns of `findings`."""
    pages = corpus.pages(spark, sf_dir, text=False).filter(seeds.EXERCISE_PAGES)
    rows = None
    for seeded in seeds.EXERCISE_FINDINGS:
        part = pages.selectExpr(*seeds.exercise_finding_columns(*seeded))
        rows = part if rows is None else rows.unionByName(part)
    return rows

