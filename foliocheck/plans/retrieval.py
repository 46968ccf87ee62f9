"""Queries of model answers, requests, retrieval, commands and streams."""
import os
import uuid

from pyspark.sql import Window as W, functions as F

from foliocheck.functions import text as T
from foliocheck.operators import contexts as X, retrieval as R
from foliocheck.plans import structure as PS
from foliocheck.plans.stats import view
from foliocheck.sources import corpus, findings as FS, responses as A
from foliocheck.session import checkpoint_dir
from foliocheck.streaming import jobs

PAGE = ["book_id", "page_number"]


def a12(spark, d):
    p = A.parse_model_findings(corpus.model_responses(spark, d))
    return p.select("doc_id", "reject", F.size("issues").cast("bigint").alias("issues"), F.get("issues", F.lit(0))["quote"].alias("quote"),
                    F.get("issues", F.lit(1))["type"].alias("type"), F.get(F.get("issues", F.lit(0))["box_2d"], F.lit(2)).alias("ymax"))


def companion(spark, d):
    return corpus.table(spark, d, "conversations").filter("role = 'assistant'").selectExpr(
        "conv_id", "turn", "CASE (conv_id + turn) % 4 WHEN 0 THEN 'MAX_TOKENS' WHEN 1 THEN 'STOP' END AS finish_reason",
        """CASE conv_id % 5 WHEN 0 THEN concat('{"answer":"Turn ', turn, '","observations":[{"quote":"a ', conv_id, '","suggestion":"b","explanation":"c","type":"spelling","severity":"minor"},',
           '{"quote":"a","suggestion":"a","explanation":"c","type":"spelling","severity":"minor"},{"quote":"a","suggestion":"b","explanation":"c","type":"image","severity":"minor"}]}')
           WHEN 1 THEN '{"answer":"Verified","observations":[]}' WHEN 2 THEN '{"answer":"  ","observations":[]}' WHEN 3 THEN '{"answer":"x"}' ELSE text END AS raw""")


def a13(spark, d):
    p = A.parse_companion(companion(spark, d))
    return p.select("conv_id", "turn", "reject", "answer", F.size("observations").cast("bigint").alias("observations"), F.get("observations", F.lit(0))["quote"].alias("quote"))


def a14(spark, d):
    pages = corpus.pages(spark, d)
    pack = A.build_request_pack(pages, FS.findings(spark, d), X.local_context(pages, PS.chapters(spark, d)), PS.j19(spark, d), F.lit("Keep to the style sheet."))
    return pack.select(*PAGE, F.sha2("transcript", 256).alias("transcript"), F.sha2("context", 256).alias("context"), F.length("knowledge").cast("bigint").alias("knowledge_chars"),
                       "prior", "instructions")


def b17(spark, d):
    m = corpus.chat(spark, d).select("conv_id", "turn", T.issue_refs(F.col("message")).alias("refs"))
    return m.select("conv_id", "turn", F.array_join(F.transform("refs", lambda v: v.cast("string")), ",").alias("refs"))


def b18(spark, d):
    return corpus.chat(spark, d).select("conv_id", "turn", R.parse_command(F.col("message")).alias("c")).select("conv_id", "turn", "c.*")


def queries_of(spark, d):
    return corpus.chat(spark, d).selectExpr("conv_id * 100 + turn AS query_id", "concat('book-', lpad(CAST(conv_id div 7 AS STRING), 12, '0')) AS book_id",
                                            "CAST(turn % 50 + 1 AS INT) AS page_number", "message")


def w8(spark, d):
    number = F.row_number().over(W.partitionBy("book_id").orderBy("page_number", "seq", "uid")).cast("bigint")
    return R.rank_findings(queries_of(spark, d), FS.findings(spark, d).withColumn("number", number))


def w9(spark, d):
    c = corpus.pages(spark, d).select(*PAGE, F.posexplode(R.chunk_text(F.col("text"))).alias("chunk_no", "chunk"))
    return c.select(*PAGE, "chunk_no", F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("digest"))


def w10(spark, d):
    q = queries_of(spark, d).join(corpus.pages(spark, d).select(*PAGE, "text"), PAGE).withColumn(
        "selected", F.expr("CASE WHEN query_id % 3 = 0 THEN substring(text, 1, 40) ELSE '' END"))
    return R.retrieve_context(q).select("query_id", F.length("context").alias("chars"), F.sha2("context", 256).alias("digest"))


def _drain(stream, mode):
    """Runs a stream over what is there now into a table folder and reads the table back."""
    spark = stream.sparkSession
    run = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"

    def write(batch, batch_id):
        # A complete result replaces the table; appended rows go under their batch number, so a
        # batch that is repeated after a failure replaces only itself.
        batch.write.mode("overwrite").parquet(f"{run}/table" if mode == "complete" else f"{run}/table/batch={batch_id}")
    q = (stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
         .option("checkpointLocation", f"{run}/checkpoint").start())
    q.awaitTermination()
    return spark.read.parquet(f"{run}/table").select(stream.columns)


def event_stream(spark, d):
    """The event files as a stream of findings: what was found, how severe, what became of it."""
    # The table is one file or a folder of part files; a stream watches folders.
    table = spark.read.parquet(f"{d}/events.parquet")
    one_file = {os.path.basename(f) for f in table.inputFiles()} == {"events.parquet"}
    files = spark.readStream.schema(table.schema)
    e = files.option("pathGlobFilter", "events.parquet").parquet(d) if one_file else files.parquet(f"{d}/events.parquet")
    return e.selectExpr(
        "concat('book-', lpad(CAST(event_id div 500 AS STRING), 12, '0')) AS book_id", "CAST(event_id div 10 % 50 + 1 AS INT) AS page_number", "CAST(event_id AS STRING) AS uid",
        "CASE event_type WHEN 'click' THEN 'spelling' WHEN 'view' THEN 'heading' ELSE 'image' END AS type", "CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' ELSE 'minor' END AS severity",
        "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'dismissed' ELSE 'open' END AS status", "'ai' AS box_source",
        "value AS xmin", "value AS ymin", "value + 10 AS xmax", "value + 5 AS ymax")


def s5(spark, d):
    out = jobs.live_findings(event_stream(spark, d)).select("book_id", "page_number", "uid", "severity", "category", "resolved", "ignored")
    return _drain(out, "append")


def s6(spark, d):
    return _drain(jobs.live_stats(event_stream(spark, d)), "complete")


QUERIES = {
    "a12_parse_model_findings": a12, "a13_parse_companion": a13, "a14_build_request_pack": a14, "b17_parse_issue_refs": b17, "b18_parse_command": b18,
    "w8_rank_findings": w8, "w9_chunk_text": w9, "w10_retrieve_context": w10, "s5_live_findings": s5, "s6_live_stats": s6,
}
