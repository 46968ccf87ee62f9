"""Rules over page text. Each rule is a row of data; all of them share one scan of the text.

Offsets are code points from the start of the page text.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliocheck import constants as C
from foliocheck.functions import digits as N

PAGE = ["book_id", "page_number"]


@dataclass(frozen=True)
class TextRule:
    """A regular expression and the finding it produces.

    `lead` is stripped from the front of a match before it is quoted; `template` rewrites the
    match into the suggestion; `explanation` may use $quote and $suggestion.
    """
    rule_id: str
    order: int
    pattern: str
    type: str
    severity: str
    confidence: float
    rewrite: str
    template: str
    explanation: str
    lead: str = ""
    literal: str = ""        # text every match contains, tested before the pattern


TEXT_RULES = [
    TextRule("heading_colon", 1, C.P_HEADING_COLON, "punctuation", "major", 0.98,
             r"^(.*?)[ \t]+(:-|:—|:)$", "$1$2 ",
             "Remove the space before the colon: write $suggestion", lead=r"^[\n.!?]?[ \t]*", literal=":"),
    TextRule("conjunction_colon", 2, C.P_CONJUNCTION_COLON, "punctuation", "major", 0.96,
             C.P_CONJUNCTION_COLON, "$1 $2", "No colon before a conjunction: write $suggestion", literal=":"),
    TextRule("malformed_colon", 5, C.P_MALFORMED_COLON, "punctuation", "minor", 0.95,
             r"^([A-Za-z0-9]+)\s*(::|\s+-\s+:)$", "$1:", "Malformed colon: write $suggestion", literal=":"),
    TextRule("modal_capital", 6, C.P_MODAL_CAPITAL, "typography", "minor", 0.98,
             r"^(.*)Complete$", "$1complete", "A verb after a modal verb starts with a small letter",
             literal="Complete"),
]
EXTRA_SCANS = [("page_label", C.P_PAGE_LABEL, ""), ("example", C.P_EXAMPLE, "")]

FINDING_COLUMNS = ["book_id", "page_number", "doc_id", "rule_id", "seq", "type", "severity", "quote", "suggestion",
                   "explanation", "xmin", "ymin", "xmax", "ymax", "box_source", "source",
                   "text_start", "text_end", "confidence"]


def scan(pages: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Every match of every (rule_id, pattern, needed literal) with its offset: one row per match.

    A page is first tested against each pattern, behind a plain substring test where a match
    must contain a literal, and is split only for the rules it matches. Offsets are running sums
    over the matches of a page, so a page with very many matches stays linear.
    """
    def tested(rule_id: str, pattern: str, literal: str) -> Column:
        test = F.col("text").rlike(pattern)
        if literal:
            test = F.col("text").contains(literal) & test
        return F.when(test, F.lit(rule_id))

    def pick(value) -> Column:
        out = F.lit(None)
        for rule_id, pattern, _ in patterns:
            out = F.when(F.col("rule_id") == rule_id, value(pattern)).otherwise(out)
        return out

    keep = [c for c in ("book_id", "page_number", "doc_id", "expected", "page_count") if c in pages.columns]
    rows = (pages.select(*keep, "text", F.explode(F.array_compact(F.array(*[tested(*p) for p in patterns]))).alias("rule_id"))
            .select(*keep, "rule_id", pick(lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("hits"),
                    pick(lambda p: F.split("text", p, -1)).alias("parts")))
    gap = F.transform("parts", lambda p: F.length(p))
    following = F.slice(F.transform("parts", lambda p: F.substring(p, 1, 1)), F.lit(2), F.size("parts"))
    rows = (rows.select(*keep, "rule_id", F.posexplode(
                F.arrays_zip(F.col("hits").alias("hit"), gap.alias("gap"), following.alias("next_char"))).alias("i", "m"))
            .select(*keep, "rule_id", "i", "m.*").filter("hit IS NOT NULL")
            .repartition(*PAGE))
    w = W.partitionBy(*PAGE, "rule_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.length("hit")).over(w)
    return rows.withColumn("at", (end - F.length("hit")).cast("int")).drop("gap")


def rule_findings(matches: DataFrame, rules: list[TextRule] = TEXT_RULES) -> DataFrame:
    """Findings of the rewriting rules and of the numbering rule, in one pass over the matches.

    Numbering compares each label ("Example 3") with the previous number of the same label on
    the page: equal is a duplicate, more than one ahead is a gap.
    """
    example = F.col("rule_id") == "example"

    def pick(value, numbering) -> Column:
        out = F.when(example, numbering)
        for r in rules:
            v = value(r)
            out = out.when(F.col("rule_id") == r.rule_id, v if isinstance(v, Column) else F.lit(v))
        return out

    m = matches.filter(F.col("rule_id").isin([r.rule_id for r in rules] + ["example"]))
    m = (m.withColumn("label", F.when(example, F.lower(F.regexp_extract("hit", C.P_EXAMPLE, 1))))
         .withColumn("num", F.when(example, N.plain(F.regexp_extract("hit", C.P_EXAMPLE, 2)))))
    w = W.partitionBy(*PAGE, "rule_id", "label").orderBy("at")
    m = m.withColumn("prev", F.lag("num").over(w)).withColumn("prev_hit", F.lag("hit").over(w))
    ahead = (N.order(F.col("num")) > N.order(F.col("prev"))) & (F.col("num") != N.successor(F.col("prev")))
    m = m.filter(~example | (F.col("num") == F.col("prev")) | ahead)
    m = m.withColumn("cut", pick(lambda r: F.regexp_replace("hit", r.lead, "") if r.lead else F.col("hit"), F.col("hit")))
    m = (m.withColumn("text_start", (F.col("at") + F.length("hit") - F.length("cut")).cast("int"))
         .withColumn("quote", F.regexp_replace("cut", r"\s+$", ""))
         .withColumn("text_end", (F.col("text_start") + F.length("quote")).cast("int"))
         .withColumn("suggestion", pick(
             lambda r: F.regexp_replace("quote", r.rewrite, r.template),
             F.concat(F.regexp_replace("quote", r"\d+$", ""), N.successor(F.col("prev"))))))
    head = F.regexp_extract("quote", r"^(.*?)[ \t]+(?::-|:—|:)$", 1)
    skip = (F.col("rule_id") == "heading_colon") & (
        (head.rlike(r"^\d+$") & F.coalesce(F.col("next_char").rlike(r"^\d"), F.lit(False)))
        | head.rlike(r"(?i)^(http|https|e\.g|i\.e)$") | (head == ""))
    same = F.col("num") == F.col("prev")
    return as_findings(
        m.filter(~skip), order=pick(lambda r: r.order, F.lit(4)), type=pick(lambda r: r.type, F.lit("examples")),
        severity=pick(lambda r: r.severity, F.when(same, "major").otherwise("minor")),
        confidence=pick(lambda r: r.confidence, F.when(same, 0.92).otherwise(0.88)),
        explanation=pick(
            lambda r: F.replace(F.lit(r.explanation), F.lit("$suggestion"), F.col("suggestion")),
            F.concat(F.when(same, "Duplicate number: repeats ").otherwise("Number skipped after "), "prev_hit")))


def as_findings(m: DataFrame, order, type, severity, confidence, explanation) -> DataFrame:
    """Common finding columns; a rule finding has no measured box until it is located."""
    rule = F.when(F.col("rule_id") == "example", "example_number").otherwise(F.col("rule_id"))
    return m.select(
        "book_id", "page_number", "doc_id", rule.alias("rule_id"),
        (order.cast("bigint") * 10000000 + F.col("text_start")).alias("seq"),
        type.alias("type"), severity.alias("severity"), "quote", "suggestion", explanation.alias("explanation"),
        F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(1000.0).alias("xmax"), F.lit(1000.0).alias("ymax"),
        F.lit("unverified").alias("box_source"), F.lit("linter").alias("source"),
        F.col("text_start").cast("int").alias("text_start"), F.col("text_end").cast("int").alias("text_end"),
        confidence.cast("double").alias("confidence"))


def last_number(pages: DataFrame) -> DataFrame:
    """The last token of a page where it is a plausible page number."""
    token = F.regexp_extract("text", r"(?:^|\s)(\d{1,4})\s*$", 1)
    keep = [c for c in ("book_id", "page_number", "doc_id", "expected", "page_count") if c in pages.columns]
    return (pages.withColumn("hit", token).filter("hit <> ''")
            .filter("CAST(hit AS INT) > 0 AND CAST(hit AS INT) <= page_count + 50")
            .select(*keep, "hit", (F.length(F.regexp_replace("text", r"\s+$", "")) - F.length("hit")).cast("int").alias("at"),
                    F.lit(1).alias("tail")))


def page_number_findings(pages: DataFrame, matches: DataFrame) -> DataFrame:
    """First printed number of a page more than 15 away from the expected one.

    `expected` may be null: then the page is not checked.
    """
    labels = matches.filter("rule_id = 'page_label'").select(
        *PAGE, "doc_id", "expected", "page_count", "hit", "at", F.lit(0).alias("tail"))
    n = labels.unionByName(last_number(pages).select(labels.columns))
    n = n.withColumn("num", N.plain(F.regexp_extract("hit", r"(\d+)\s*$", 1)))
    # A number that no type holds is far from any page number.
    far = F.coalesce(F.abs(N.number(F.col("num")) - F.col("expected")) > 15, F.lit(True))
    n = n.filter("expected IS NOT NULL AND expected <> 0").filter(far)
    w = W.partitionBy(*PAGE).orderBy("tail", "at")
    n = n.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    n = (n.withColumn("rule_id", F.lit("page_number")).withColumn("quote", F.col("hit"))
         .withColumn("text_start", F.col("at")).withColumn("text_end", F.col("at") + F.length("hit"))
         .withColumn("suggestion", F.concat(F.lit("Page "), F.col("expected").cast("string"))))
    return as_findings(n, F.lit(3), F.lit("page_number"), F.lit("major"), F.lit(0.85),
                       F.concat(F.lit("Printed page number "), "num",
                                F.lit(" differs from the expected "), F.col("expected").cast("string")))


def lint_text(pages: DataFrame, rules: list[TextRule] = TEXT_RULES) -> DataFrame:
    """All text rules over all pages.

    The page number rule needs `expected` and `page_count` columns and is left out without them.
    """
    patterns = [(r.rule_id, r.pattern, r.literal) for r in rules] + EXTRA_SCANS
    if "expected" not in pages.columns:
        return rule_findings(scan(pages, [p for p in patterns if p[0] != "page_label"]), rules)
    matches = scan(pages, patterns)
    return rule_findings(matches, rules).unionByName(page_number_findings(pages, matches))


def with_uid(findings: DataFrame) -> DataFrame:
    """A finding's identity is a hash of what it says and where, so reruns give the same id."""
    key = F.concat_ws("|", "book_id", F.col("page_number").cast("string"), "rule_id",
                      F.coalesce(F.col("text_start").cast("string"), F.lit("-")), "quote")
    return findings.withColumn("uid", F.sha2(key, 256))
