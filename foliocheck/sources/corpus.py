"""Input tables of the engine, derived from the given tables without a shuffle of page text.

A book is a run of `PAGES_PER_BOOK` documents, so a book is always a bounded group however
the document sources are distributed. Word boxes are computed map-side from the page text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliocheck.session import ship_package
from foliocheck.sources import printed, seeds

PAGE_KEY = ["book_id", "page_number"]
_ODD_SPACE = r"[\t\r\x0B\x0C\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exprs(columns: list[tuple[str, str]]):
    return [F.expr(sql).alias(name) for name, sql in columns]


def plain_spaces(col):
    """Odd space characters become one blank each, so offsets never move."""
    return F.regexp_replace(col, _ODD_SPACE, " ")


def pages(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cols = _exprs(seeds.page_columns("div"))
    if text:
        cols.append(F.expr(seeds.page_text("div")).alias("text"))
        docs = docs.withColumn("text", plain_spaces(F.col("text")))
    return docs.select(*cols)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grouped = docs.groupBy(F.expr(seeds.book_no("div")).alias("book_no")).agg(
        F.expr(seeds.book_id("div").replace("doc_id", "min(doc_id)")).alias("book_id"),
        F.count("*").alias("page_count"), F.min_by("lang", "doc_id").alias("lang"))
    return grouped.select(*_exprs(seeds.book_columns()))


#: Fields of a printed word that are the same for all.
_PRINTED = {"source": "'pdf_text'", "confidence": "CAST(NULL AS DOUBLE)", "block_id": "CAST(NULL AS STRING)", "paragraph_id": "CAST(NULL AS STRING)",
            "line_id": "CAST(NULL AS STRING)", "role": "CAST(NULL AS STRING)"}


def pages_of(page_rows: DataFrame) -> DataFrame:
    """Printed word boxes of page texts: one row per page that has any, its words as an array in stored order. Other columns stay.

    Words are placed where the text is, so neither a window nor a shuffle is needed. Crowded pages get a smaller line pitch instead of losing rows.
    """
    ship_package(page_rows.sparkSession)
    # Not to be repeated below a shuffle by a filter on its result.
    place = F.arrow_udf(printed.place_words, f"array<{printed.WORD}>").asNondeterministic()
    rows = page_rows.select(*[c for c in page_rows.columns if c != "text"], place(
        F.col("text"), F.expr(f"CASE WHEN {seeds.EXERCISE_PAGES} THEN 300.0D ELSE 40.0D END"), F.expr("page_number = 1"), F.expr(seeds.EXERCISE_PAGES)).alias("words"))
    return rows.filter("size(words) > 0")


def words_of(page_rows: DataFrame) -> DataFrame:
    """The words of `pages_of` as rows, without the fields that are the same for all."""
    return pages_of(page_rows).select(*PAGE_KEY, "doc_id", F.inline("words"))


#: Characters of page text in one partition: its word rows are some sixty times larger and are sorted in one task.
CHARS_PER_PARTITION = 4_000_000


def text_partitions(docs: DataFrame) -> int:
    """How many partitions page texts need, so that the words of one can be sorted in memory whatever the size of the table."""
    chars = docs.agg(F.sum("n_chars")).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(chars) // CHARS_PER_PARTITION + 1)


def text_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts partitioned by page key. The number of partitions is stated: texts alone are small and would be put together into few."""
    given = table(spark, sf_dir, "documents")
    docs = given.selectExpr(
        "doc_id", "text", f"{seeds.book_id('div')} AS book_id", f"{seeds.PAGE_NUMBER} AS page_number")
    return (docs.repartition(text_partitions(given), *PAGE_KEY).withColumn("text", plain_spaces(F.col("text")))
            .select("doc_id", *PAGE_KEY, F.expr(seeds.page_text("div")).alias("text")))


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes, partitioned by page.

    A Python function hides how its input is partitioned, so the word rows move once more; every window, group and join on the page key then reuses
    that partitioning.
    """
    texts = text_by_page(spark, sf_dir)
    return words_of(texts).repartition(text_partitions(table(spark, sf_dir, "documents")), *PAGE_KEY).withColumns(
        {name: F.expr(sql) for name, sql in _PRINTED.items()})


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_words(spark, sf_dir).drop("doc_id")


def _texts(spark: SparkSession, sf_dir: str, beside: DataFrame | None, only: Column | None) -> DataFrame:
    """Page texts with the row of `beside` for their page, if `only` holds for the text: both are settled before the much larger words are made."""
    texts = text_by_page(spark, sf_dir)
    texts = texts if only is None else texts.filter(only)
    return texts if beside is None else texts.join(beside, PAGE_KEY)


def word_pages(spark: SparkSession, sf_dir: str, beside: DataFrame | None = None, only: Column | None = None) -> DataFrame:
    """The words of `words`, a page a row."""
    return pages_of(_texts(spark, sf_dir, beside, only)).drop("doc_id")


# Share of each recognised word: confidence runs 0..0.99 over the word positions.
OCR_CONFIDENCE = "CAST((doc_id * 31 + text_start) % 100 AS DOUBLE) / 100"


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes as a recogniser would report them, weak words (<.35) left out."""
    w = page_words(spark, sf_dir).withColumn("confidence", F.expr(OCR_CONFIDENCE))
    row = "CAST(floor(ymin) AS STRING)"
    return (w.filter("confidence >= 0.35").withColumn("source", F.lit("ocr_text"))
            .withColumn("block_id", F.expr("CAST(CAST(floor(ymin / 100) AS INT) AS STRING)"))
            .withColumn("paragraph_id", F.lit("1")).withColumn("line_id", F.expr(row)).drop("doc_id"))


def ocr_words_beside(spark: SparkSession, sf_dir: str, beside: DataFrame) -> DataFrame:
    """The words of `ocr_words` without the ids of blocks and lines, as rows with the columns that `beside` has for their page; they stay where the page is."""
    also = [c for c in beside.columns if c not in PAGE_KEY]
    rows = pages_of(_texts(spark, sf_dir, beside, None)).select(*PAGE_KEY, "doc_id", *also, F.inline("words"))
    return rows.withColumn("confidence", F.expr(OCR_CONFIDENCE)).filter("confidence >= 0.35").drop("doc_id")


_PLACED = ["word_idx", "str", "xmin", "ymin", "xmax", "ymax", "text_start", "text_end"]
#: Fields of a recognised word.
_OCR_FIELDS = {c: f"w.{c}" for c in _PLACED} | {
    "source": "'ocr_text'", "confidence": OCR_CONFIDENCE.replace("text_start", "w.text_start"), "block_id": "CAST(CAST(floor(w.ymin / 100) AS INT) AS STRING)",
    "paragraph_id": "'1'", "line_id": "CAST(floor(w.ymin) AS STRING)"}


def ocr_word_lists(spark: SparkSession, sf_dir: str, lists: dict[str, tuple[str, list[str]]], beside: DataFrame | None = None) -> DataFrame:
    """Some of the words of `ocr_words`, a page a row. Each list names what must hold for a word `w`, beside its confidence, and its fields; both are read
    straight from the printed words, since a row's lists are worked through word by word."""
    also = [] if beside is None else [c for c in beside.columns if c not in PAGE_KEY]

    def listed(only: str, fields: list[str]) -> str:
        kept = f"filter(words, w -> ({only}) AND {_OCR_FIELDS['confidence']} >= 0.35)"
        struct = ", ".join(f"{_OCR_FIELDS[c]} AS {c}" for c in fields)
        return f"transform({kept}, w -> struct({struct}))" if set(fields) - set(_PLACED) else kept
    columns = [F.expr(listed(*how)).alias(name) for name, how in lists.items()]
    return pages_of(_texts(spark, sf_dir, beside, None)).select(*PAGE_KEY, *also, *columns)


def ocr_word_pages(spark: SparkSession, sf_dir: str, beside: DataFrame | None = None) -> DataFrame:
    """The words of `ocr_words`, a page a row."""
    return ocr_word_lists(spark, sf_dir, {"words": ("true", list(_OCR_FIELDS))}, beside).filter("size(words) > 0")


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        f"{seeds.book_id('div')} AS book_id", f"{seeds.PAGE_NUMBER} AS page_number", "doc_id",
        f"{seeds.model_json()} AS raw",
        "CASE doc_id % 10 WHEN 7 THEN 'MAX_TOKENS' WHEN 8 THEN NULL WHEN 9 THEN 'FINISH_REASON_UNSPECIFIED' "
        "ELSE 'STOP' END AS finish_reason")


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", *_exprs(seeds.raw_issue_columns()))
    numbers = F.expr("CASE WHEN bn IS NOT NULL THEN slice(array(b0, b1, b2, b3), 1, bn) END")
    return rows.withColumn("box_2d", numbers).drop("bn", "b0", "b1", "b2", "b3")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{seeds.ERROR_MESSAGE} AS error")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations; a conversation talks about the book of its number."""
    return (table(spark, sf_dir, "conversations").filter("role = 'user'")
            .selectExpr("conv_id", "turn", f"{seeds.CHAT_TEXT} AS message"))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{seeds.INSTRUCTION_TEXT} AS raw")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.expr(seeds.book_id("div")).alias("book_id"), "doc_id",
                                                 *_exprs(seeds.MARK_COLUMNS))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload manifest: one file per web page."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CASE WHEN page_id % 9 = 8 THEN 'scan.png' ELSE concat('Book ', page_id, '.PDF') END AS file_name",
        "CASE WHEN page_id % 11 = 10 THEN 0L WHEN page_id % 13 = 12 THEN 262144001L ELSE CAST(length(html) AS BIGINT) END AS size",
        "CASE WHEN page_id % 10 = 3 THEN 'PK' ELSE '%PDF-' END AS magic",
        "concat('proofreader_assets/pdf_', CASE WHEN page_id % 7 = 6 THEN 'a..b/' ELSE '' END, page_id) AS object_key",
        "page_id % 70 AS parts")


def upload_parts(spark: SparkSession, sf_dir: str, size: int = 4000) -> DataFrame:
    """Files cut in parts; some files miss their second part."""
    return (table(spark, sf_dir, "pages")
            .selectExpr("page_id", "html", f"CAST(ceil(length(html) / {size}D) AS INT) AS declared")
            .selectExpr("page_id", "declared", "html", "explode(sequence(0, declared - 1)) AS idx")
            .filter("NOT (page_id % 6 = 5 AND idx = 1)")
            .selectExpr("page_id", "declared", "idx", f"substring(html, idx * {size} + 1, {size}) AS body"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing attempts: ten consecutive events belong to one page, so a book stays bounded."""
    e = table(spark, sf_dir, "events").withColumn("doc_id", F.expr("event_id div 10"))
    return e.select(
        F.expr(seeds.book_id("div")).alias("book_id"), F.expr(seeds.PAGE_NUMBER).alias("page_number"), "event_id",
        F.col("ts").alias("heartbeat_at"), F.expr("event_type = 'error'").alias("failed"),
        F.expr(f"CASE WHEN event_type = 'error' THEN {seeds.ERROR_MESSAGE} END").alias("error"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word boxes as a recogniser's tab-separated rows over a 2000 x 1000 image."""
    return page_words(spark, sf_dir).selectExpr(
        "book_id", "page_number", "word_idx AS line_no", "2000 AS width", "1000 AS height",
        "concat_ws('\t', CASE WHEN text_start % 41 = 40 THEN '4' ELSE '5' END, '1', CAST(CAST(floor(ymin / 100) AS INT) AS STRING), '1', "
        "CAST(CAST(floor(ymin) AS BIGINT) AS STRING), CAST(text_start AS STRING), "
        "CASE WHEN text_start % 53 = 52 THEN 'NaN' ELSE CAST(CAST(floor(xmin * 2) AS BIGINT) AS STRING) END, CAST(CAST(floor(ymin) AS BIGINT) AS STRING), "
        "CAST(CAST(floor((xmax - xmin) * 2) AS BIGINT) AS STRING), '12', CAST((doc_id * 31 + text_start) % 100 AS STRING), str) AS line")


# Affine transforms of a run by document: 0, 90, 180 and 270 degrees at 10 points.
RUN_MATRIX = [("a", [10, 0, -10, 0]), ("b", [0, 10, 0, -10]), ("c", [0, -10, 0, 10]), ("d", [10, 0, -10, 0])]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs as a page renderer reports them: one per line, rotated by document."""
    lines = text_by_page(spark, sf_dir).select("book_id", "page_number", "doc_id", F.posexplode(F.split("text", "\n")).alias("run_idx", "str"))
    mat = [f"CAST(CASE doc_id % 4 WHEN 0 THEN {v[0]} WHEN 1 THEN {v[1]} WHEN 2 THEN {v[2]} ELSE {v[3]} END AS DOUBLE) AS {n}"
           for n, v in RUN_MATRIX]
    return lines.selectExpr("book_id", "page_number", "run_idx", "str", *mat,
                            "CAST(250 + doc_id % 100 AS DOUBLE) AS e", "CAST(400 + (run_idx * 12) % 300 AS DOUBLE) AS f",
                            "5.0D * length(str) AS width", "10.0D AS height", "CAST(NULL AS DOUBLE) AS ascent",
                            "CAST(NULL AS DOUBLE) AS descent", "600.0D AS viewport_width", "800.0D AS viewport_height",
                            "array(1.0D, 0.0D, 0.0D, -1.0D, 0.0D, 800.0D) AS viewport")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks of each book: units (or parts) with their chapters below, and an appendix."""
    p = "(doc_id % 50 + 1)"
    base = table(spark, sf_dir, "documents").selectExpr(f"{seeds.book_id('div')} AS book_id", f"{p} AS p").filter("p % 8 = 2 OR p = 50")
    units = base.filter("p % 16 = 2").selectExpr(
        "book_id", "CAST(p * 10 + 1 AS INT) AS node_id", "CAST(NULL AS INT) AS parent_id", "CAST(p AS INT) AS ord",
        "CASE WHEN p % 32 = 2 THEN concat('Unit ', p div 16 + 1, ': Thinking') ELSE concat('Part ', p div 16 + 1) END AS title", "CAST(NULL AS INT) AS page")
    chapters = base.filter("p % 8 = 2").selectExpr(
        "book_id", "CAST(p * 10 + 2 AS INT) AS node_id", "CAST(((p - 2) div 16 * 16 + 2) * 10 + 1 AS INT) AS parent_id", "CAST(p AS INT) AS ord",
        "concat('Chapter ', p div 8 + 1, ': Topic ', p div 8 + 1) AS title", "CAST(CASE WHEN p % 24 = 2 THEN 999 ELSE p END AS INT) AS page")
    last = base.filter("p = 50").selectExpr("book_id", "900 AS node_id", "CAST(NULL AS INT) AS parent_id", "99 AS ord", "'Appendix' AS title", "50 AS page")
    return units.unionByName(chapters).unionByName(last)
