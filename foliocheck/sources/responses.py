"""Model output and input tables: strict parsing of answers, bounded request rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliocheck import constants as C
from foliocheck.functions import text as T

ISSUE = "struct<type:string,severity:string,quote:string,suggestion:string,explanation:string,box_2d:array<double>,confidence:double>"
ANSWER = f"struct<pageKind:string,layoutNotes:string,issues:array<{ISSUE}>>"
COMPANION = "struct<answer:string,observations:array<struct<quote:string,suggestion:string,explanation:string,type:string,severity:string>>>"


def _parsed(raw: Column, schema: str) -> Column:
    """The JSON object, or the outermost braces of a text that wraps one."""
    strict = F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, schema))
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.coalesce(strict, F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, schema)))


def parse_model_findings(responses: DataFrame) -> DataFrame:
    """Adds `issues`, or `reject` with the reason. One invalid issue rejects the whole answer, so a
    broken answer is never mistaken for a clean page."""
    finish = F.coalesce("finish_reason", F.lit(""))
    r = responses.withColumn("p", _parsed(F.col("raw"), ANSWER))

    def valid(i: Column) -> Column:
        text = i["quote"].isNotNull() & i["suggestion"].isNotNull() & i["explanation"].isNotNull()
        box = (F.size(i["box_2d"]) == 4) & F.forall(i["box_2d"], lambda v: v.isNotNull() & ~F.isnan(v))
        said = (T.strip(i["quote"]) != "") | (T.strip(i["explanation"]) != "")
        return F.coalesce(i["type"].isin(C.FINDING_TYPES) & i["severity"].isin(C.SEVERITIES) & text & box & said, F.lit(False))
    reason = (F.when(~finish.isin("", "STOP", "FINISH_REASON_UNSPECIFIED"), "truncated or blocked")
              .when(F.col("p").isNull() | F.col("p.issues").isNull() | F.col("p.pageKind").isNull(), "incomplete")
              .when(~F.forall("p.issues", valid), "invalid issue"))
    r = r.withColumn("reject", reason)
    return r.withColumn("issues", F.when(F.col("reject").isNull(), F.col("p.issues"))).drop("p")


def parse_companion(responses: DataFrame) -> DataFrame:
    """Answer and usable observations of an assistant reply, or the reason it is refused."""
    r = responses.withColumn("p", F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", COMPANION)))
    finish = F.coalesce("finish_reason", F.lit(""))
    reason = (F.when(~finish.isin("", "STOP"), "incomplete").when(F.col("p").isNull(), "invalid")
              .when((T.strip(F.coalesce("p.answer", F.lit(""))) == "") | F.col("p.observations").isNull() | (F.size("p.observations") > 50), "no evidence"))

    def usable(o: Column) -> Column:
        short = (F.length(o["quote"]) < 3000) & (F.length(o["suggestion"]) < 3000) & (F.length(o["explanation"]) < 3000)
        said = (T.strip(o["quote"]) != "") & (T.strip(o["suggestion"]) != "") & (o["quote"] != o["suggestion"])
        return F.coalesce(o["type"].isin(C.OBSERVATION_TYPES) & o["severity"].isin(C.SEVERITIES) & short & said, F.lit(False))
    r = r.withColumn("reject", reason)
    return (r.withColumn("answer", F.when(F.col("reject").isNull(), F.col("p.answer")))
            .withColumn("observations", F.when(F.col("reject").isNull(), F.filter("p.observations", usable))).drop("p"))


def build_request_pack(pages: DataFrame, findings: DataFrame, contexts: DataFrame, knowledge: DataFrame, instructions: Column, prior_chars: int = 14000) -> DataFrame:
    """One bounded request row per page: transcript, chapter context, knowledge, instructions and the earlier findings to revisit.

    `prior` is a JSON array of whole findings of at most `prior_chars` characters; `prior_left_out` says how many did not fit.
    """
    def fitting(found: Column) -> Column:
        def add(state: Column, x: Column) -> Column:
            longer = F.concat(state["text"], F.when(state["text"] == "", "").otherwise(","), x["j"])
            fits = (state["left"] == 0) & (F.length(longer) <= prior_chars - 2)
            return F.struct(F.when(fits, longer).otherwise(state["text"]).alias("text"), (state["left"] + F.when(fits, 0).otherwise(1)).alias("left"))
        return F.aggregate(found, F.struct(F.lit("").alias("text"), F.lit(0).alias("left")), add)

    prior = F.to_json(F.struct("type", "quote", "suggestion", "status"))
    f = findings.groupBy("book_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("seq", "uid", prior.alias("j")))).alias("l"))
    f = f.select("book_id", "page_number", fitting(F.col("l")).alias("p")).select(
        "book_id", "page_number", F.concat(F.lit("["), "p.text", F.lit("]")).alias("prior"), F.col("p.left").alias("prior_left_out"))
    p = (pages.select("book_id", "page_number", F.substring("text", 1, 24000).alias("transcript"))
         .join(contexts.select("book_id", "page_number", F.substring("context", 1, 10000).alias("context")), ["book_id", "page_number"], "left")
         .join(knowledge.select("book_id", "page_number", F.substring("knowledge", 1, 1800).alias("knowledge")), ["book_id", "page_number"], "left")
         .join(f, ["book_id", "page_number"], "left"))
    p = p.withColumn("prior_left_out", F.coalesce("prior_left_out", F.lit(0)))
    return p.withColumn("prior", F.coalesce("prior", F.lit("[]"))).withColumn("instructions", F.substring(instructions, 1, 2000))
