"""Projections and predicates over single findings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliocheck import constants as C
from foliocheck.functions import geometry as G, text as T


def normalize_findings(raw: DataFrame) -> DataFrame:
    """Raw model issues (raw_type, raw_severity, quote, suggestion, explanation, box_2d, raw_confidence)."""
    text = {c: T.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("quote", "suggestion", "explanation")}
    numbers = F.coalesce(F.size("box_2d"), F.lit(0))
    whole = (numbers == 4) & F.coalesce(F.forall("box_2d", lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    confidence = F.col("raw_confidence")
    return (raw.withColumns(text)
            .withColumn("type", F.when(F.col("raw_type").isin(C.FINDING_TYPES), F.col("raw_type")).otherwise("other"))
            .withColumn("severity", F.when(F.col("raw_severity").isin(C.SEVERITIES), F.col("raw_severity")).otherwise("major"))
            .filter("NOT (quote = '' AND explanation = '')")
            .withColumn("box", G.clamp_model_box(F.col("box_2d")))
            .withColumn("box_source", F.when(whole, "ai").otherwise("unverified"))
            .withColumn("confidence", F.when(G.finite(confidence), F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)))
                        .otherwise(0.7))
            .withColumn("source", F.lit("ai")).withColumn("status", F.lit("open")))


def review_view(findings: DataFrame) -> DataFrame:
    """Findings as a reviewer sees them: mapped severity, category, percent box, flags."""
    categories = F.create_map(*[F.lit(v) for kv in C.CATEGORY_OF_TYPE.items() for v in kv])
    x0, y0, x1, y1 = G.box_cols()
    valid = (G.finite(x0, y0, x1, y1) & (x0 >= 0) & (y0 >= 0) & (x1 <= 1000) & (y1 <= 1000) & (x1 > x0) & (y1 > y0)
             & (F.col("box_source") != "unverified"))
    sev = F.when(F.col("severity") == "major", "high").when(F.col("severity") == "minor", "low").otherwise(F.col("severity"))
    return (findings
            .withColumn("severity", F.when(sev.isin("critical", "high", "medium", "low"), sev).otherwise("medium"))
            .withColumn("category", F.coalesce(F.try_element_at(categories, F.col("type")), F.lit("Style")))
            .withColumn("x", F.when(valid, x0 / 10)).withColumn("y", F.when(valid, y0 / 10))
            .withColumn("w", F.when(valid, (x1 - x0) / 10)).withColumn("h", F.when(valid, (y1 - y0) / 10))
            .withColumn("resolved", F.col("status").isin("accepted", "fixed"))
            .withColumn("ignored", F.col("status") == "dismissed"))


def rule_tag(view: DataFrame) -> DataFrame:
    e, q = F.lower(F.coalesce("explanation", F.lit(""))), F.lower(F.coalesce("quote", F.lit("")))
    return view.withColumn(
        "rule_tag",
        F.when(e.contains("space before the colon") | q.contains(":-") | (q.contains(":") & e.contains("heading")),
               "Heading Colon Rule")
        .when(e.contains("colon before") | (q.contains(":") & e.contains("conjunction")), "Conjunction Colon Rule")
        .when((F.col("type") == "page_number") | e.contains("page number"), "Sequence Check")
        .when((F.col("category") == "Formatting") & e.contains("alignment"), "Alignment Check")
        .when(F.col("type") == "flow", "Sentence Flow"))


def is_measured() -> Column:
    return F.coalesce(F.col("box_source").isin(C.MEASURED_SOURCES), F.lit(False))


def is_grounded() -> Column:
    """False where a finding needs printed text that has not been found yet."""
    needs = (F.col("source") == "linter") | F.col("type").isin(C.LANGUAGE_TYPES)
    return ~(needs & ~is_measured())


def partition_grounded(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return findings.filter(is_grounded()), findings.filter(~is_grounded())


def pending_verification() -> Column:
    return ~is_measured() & F.col("type").isin(C.LANGUAGE_TYPES)


def visible_overlays(view: DataFrame) -> DataFrame:
    """Findings of a review view that can be drawn on their page."""
    return view.filter(~F.col("ignored") & G.finite(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def is_textual() -> Column:
    return (T.strip(F.coalesce("quote", F.lit(""))) != "") & ~F.col("type").isin(C.VISUAL_TYPES)


def can_repeat(fold: bool = True) -> Column:
    """A local edit of one word inside a phrase, which applies to every exact copy of it."""
    def local(t: Column) -> Column:
        b, a = t["before"], t["after"]
        same = F.size(F.filter(F.zip_with(b, a, lambda x, y: x.isNotNull() & y.isNotNull() & (x == y)), lambda v: v))
        return (F.size(b) >= 2) & (F.size(a) > 0) & (F.size(b) == F.size(a)) & (same >= F.size(b) - 1) & (same / F.size(b) >= 0.5)
    # Both token lists are bound once.
    both = F.array(F.struct(T.location_tokens(F.col("quote"), fold=fold).alias("before"),
                            T.location_tokens(F.col("suggestion"), fold=fold).alias("after")))
    return (F.col("type").isin(C.REPEATABLE_TYPES) & (F.col("quote") != F.col("suggestion"))
            & F.get(F.transform(both, local), F.lit(0)))


def classify_error(errors: DataFrame, col: str = "error") -> DataFrame:
    m, any_of = F.col(col), lambda *t: _contains_any(F.col(col), t)
    internal = m.rlike("(?i)internal error")
    fatal = (m.rlike(r"(?i)" + C.WB + "401" + C.WE + "|UNAUTHENTICATED|invalid_api_key|Incorrect API key")
             | (m.contains("403") & m.contains("PERMISSION_DENIED")) | m.rlike("(?i)denied access")
             | any_of("API key not valid", "API_KEY_INVALID"))
    missing = any_of("ENOENT", "no such file")
    retry = ~missing & ~fatal & (internal | any_of(
        "429", "RESOURCE_EXHAUSTED", "timed out", "DEADLINE", "504", "UNAVAILABLE", "503", "500",
        "fetch failed", "aborted", "JSON_PARSE_ERROR"))
    inner = F.get_json_object(T.strip(m), "$.error.message")
    friendly = (F.when(F.coalesce(m, F.lit("")) == "", "")
                .when(internal, "The model failed on its side; processing stops here so that it is not asked again and again.")
                .when(any_of("DEADLINE", "504", "timed out", "aborted"),
                      "No answer from the model in time; processing stops here so that it is not asked again and again.")
                .when(any_of("429", "RESOURCE_EXHAUSTED"),
                      "The model takes no more requests for now; processing stops here until it does.")
                .when(T.strip(m).startswith("{"), F.coalesce(inner, F.lit("The page could not be analysed")))
                .when(F.length(m) > 140, F.concat(F.substring(m, 1, 140), F.lit("…"))).otherwise(m))
    return errors.withColumns({"friendly": friendly, "fatal_auth": fatal, "retryable": retry})


def _contains_any(col: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | col.contains(p)
    return out


def important_warning(col: Column) -> Column:
    low = F.lower(col)
    return ~low.contains("candidates") & ~low.contains("first-pass")
