"""Questions about a book: commands, ranked findings, page chunks and the text that fits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliocheck.functions import text as T


def parse_command(message: Column) -> Column:
    """struct(kind, page, fact) of a direct command, null for a question."""
    n = lambda p: F.regexp_extract(message, p, 1).try_cast("int")
    go = r"(?i)^\s*(?:please\s+)?(?:go|open|show|navigate)\s+(?:to\s+)?page\s+(\d+)[.!]?\s*$"
    again = r"(?i)^\s*(?:please\s+)?re-?analy[sz]e\s+page\s+(\d+)[.!]?\s*$"
    keep = r"(?is)^\s*(?:/remember|remember(?:\s+that)?)\s+(.+)$"
    simple = lambda word: message.rlike(rf"(?i)^\s*(?:please\s+)?{word}(?:\s+(?:the\s+)?analysis)?[.!]?\s*$")
    kind = (F.when(message.rlike(keep), "remember").when(simple("pause"), "pause").when(simple("resume"), "resume")
            .when(message.rlike(go), "navigate").when(message.rlike(again), "reanalyze"))
    return F.struct(kind.alias("kind"), F.when(kind == "navigate", n(go)).when(kind == "reanalyze", n(again)).alias("page"),
                    F.when(kind == "remember", F.substring(T.strip(F.regexp_extract(message, keep, 1)), 1, 500)).alias("fact"))


def rank_findings(queries: DataFrame, findings: DataFrame, limit: int = 60) -> DataFrame:
    """The findings of its book that fit each query best.

    Referenced numbers first, then the current page, then how many query terms a finding
    contains. `queries`: query_id, book_id, page_number, message; `findings` carry `number`.
    The best rows are cut inside each partition before they are exchanged.
    """
    q = queries.select("query_id", "book_id", F.col("page_number").alias("current"), T.search_terms(F.col("message")).alias("terms"),
                       T.issue_refs(F.col("message")).alias("refs"))
    short = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 600)
    # The text a term may hit is that of the finding's record, field names included.
    record = F.lower(F.concat_ws(" ", F.lit("uid sidebarNumber page type severity quote suggestion explanation status box boxSource xmin ymin xmax ymax seenInLatestAnalysis"),
                                 "uid", F.col("number").cast("string"), F.col("page_number").cast("string"), "type", "severity",
                                 short("quote"), short("suggestion"), short("explanation"), "status", "box_source"))
    f = findings.select("book_id", "uid", "number", "page_number", record.alias("record"))
    j = q.join(f, "book_id")
    score = (F.when(F.array_contains("refs", F.col("number")), 10000).otherwise(0) + F.when(F.col("page_number") == F.col("current"), 5).otherwise(0)
             + F.size(F.filter("terms", lambda t: F.contains(F.col("record"), t))))
    j = j.select("query_id", "uid", "number", "page_number", score.cast("bigint").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "number", "uid"))
    return j.withColumn("place", place).filter(F.col("place") <= limit)


def chunk_text(col: Column, size: int = 700) -> Column:
    """Array of chunks of at most about `size` characters: whole sentences packed greedily, long
    sentences cut."""
    clean = T.squash(col)
    sentences = F.split(clean, r"(?<=[.!?।])\s+")

    def parts(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(s) - 1), F.lit(size)), lambda o: F.struct(
            (o == 0).alias("first"), F.length(s).alias("n"), F.substring(s, o + 1, F.lit(size)).alias("part")))
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def push(a: Column, when: Column) -> Column:
        return F.struct(F.when(when, "").otherwise(a["cur"]).alias("cur"),
                        F.when(when, F.concat(a["out"], F.array(F.trim(a["cur"])))).otherwise(a["out"]).alias("out"))

    def step(a: Column, p: Column) -> Column:
        a1 = push(a, p["first"] & (a["cur"] != "") & (F.length(a["cur"]) + p["n"] > size))
        a2 = push(a1, (F.length(a1["cur"]) + F.length(p["part"]) > size))
        return F.struct(F.concat(a2["cur"], F.when(a2["cur"] != "", " ").otherwise(""), p["part"]).alias("cur"), a2["out"].alias("out"))

    def finish(a: Column) -> Column:
        return F.when(a["cur"] != "", F.concat(a["out"], F.array(F.trim(a["cur"])))).otherwise(a["out"])
    packed = F.aggregate(F.flatten(F.transform(sentences, parts)), start, step, finish)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(packed)


def retrieve_context(rows: DataFrame, max_chars: int = 12000) -> DataFrame:
    """Adds `context`: the chunks of `text` that answer `message` best and fit together.

    A chunk that does not fit is skipped, not the end; at most 18 chunks. `selected` is text the
    user marked; it always comes first. Every row is decided on its own.
    """
    picked = F.substring(T.squash(F.col("selected")), 1, 1800)
    r = rows.withColumn("chunks", chunk_text(F.col("text"))).withColumn("picked", picked)
    r = r.withColumn("terms", T.search_terms(F.concat_ws(" ", "message", "picked")))
    ranked = F.array_sort(F.transform("chunks", lambda c, i: F.struct(
        (-F.size(F.filter("terms", lambda t: F.contains(F.lower(c), t)))).alias("s"), i.alias("i"), c.alias("c"))))
    r = r.withColumn("ranked", ranked)
    has = F.col("picked") != ""
    start = F.struct(F.when(has, F.length("picked")).otherwise(0).alias("used"),
                     F.when(has, F.array(F.concat(F.lit("User-selected text: "), "picked"))).otherwise(F.array().cast("array<string>")).alias("out"))

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["out"]) < 18) & (a["used"] + F.length(x["c"]) <= max_chars)
        return F.struct(F.when(fits, a["used"] + F.length(x["c"])).otherwise(a["used"]).alias("used"),
                        F.when(fits, F.concat(a["out"], F.array(x["c"]))).otherwise(a["out"]).alias("out"))
    chosen = F.aggregate("ranked", start, step, lambda a: a["out"])
    return r.withColumn("context", F.substring(F.array_join(chosen, "\n\n"), 1, max_chars)).drop("chunks", "picked", "terms", "ranked")
