"""Queries of book structure and chapter contexts."""
from functools import partial

from pyspark.sql import functions as F

from foliocheck.functions import text as T
from foliocheck.operators import contexts as X, structure as S
from foliocheck.sources import corpus, seeds

PAGE = ["book_id", "page_number"]


def chapters(spark, d):
    """Chapters from page text alone."""
    return S.infer_chapters(corpus.books(spark, d), corpus.pages(spark, d))


def headers(spark, d):
    return S.observed_headings(corpus.pages(spark, d)).filter("unit <> ''")


def contents(spark, d):
    return corpus.pages(spark, d).filter(T.is_contents_page(F.col("text"))).select(*PAGE)


def outline_chapters(spark, d):
    f = S.flatten_outline(corpus.outline(spark, d), corpus.books(spark, d)).filter("name IS NOT NULL")
    return f.select("book_id", "title", "number", "name", "page", "unit", F.lit("pdf").alias("page_numbering"), F.col("place").cast("bigint").alias("ord"))


def toc_rows(spark, d):
    """Contents rows of all origins: bookmarks, headings and printed lines, some of them twice."""
    o = S.flatten_outline(corpus.outline(spark, d), corpus.books(spark, d)).select(
        "book_id", "title", "page", F.lit(None).cast("int").alias("printed_page"), F.lit("pdf").alias("page_numbering"), F.col("place").cast("bigint").alias("ord"))
    p = S.printed_toc(corpus.pages(spark, d)).select("book_id", "title", F.lit(None).cast("int").alias("page"), "printed_page", F.lit("printed").alias("page_numbering"),
                                                     (F.col("line_no") + 1000).cast("bigint").alias("ord"))
    return o.unionByName(o.withColumn("ord", F.col("ord") + 500)).unionByName(p)


def contexts(spark, d):
    """Contexts of an earlier run: two thirds unchanged, the rest outdated, one vanished chapter per book."""
    ch = chapters(spark, d)
    src = X.chapter_source(corpus.pages(spark, d), ch).join(ch.select("book_id", "chapter_key", "start_page"), ["book_id", "chapter_key"])
    no = "CAST(substring(book_id, 6, 20) AS BIGINT)"
    cur = src.filter("start_page <> 42").selectExpr(
        "book_id", "chapter_key", f"CASE WHEN ({no} + start_page) % 3 = 0 THEN 'old' ELSE content_hash END AS content_hash", "'chapter-context-v2' AS analysis_version",
        f"CASE WHEN {no} % 4 = 3 AND start_page = 10 THEN 'error' WHEN {no} % 2 = 0 OR start_page < 20 THEN 'ready' ELSE 'pending' END AS status", "CAST(start_page * 10 AS BIGINT) AS tokens_used")
    gone = corpus.books(spark, d).selectExpr("book_id", "'chapter-7-gone' AS chapter_key", "'x' AS content_hash", "'chapter-context-v1' AS analysis_version", "'ready' AS status", "5L AS tokens_used")
    return cur.unionByName(gone)


def j2(spark, d):
    p = corpus.pages(spark, d, text=False)
    e = S.expected_chapter(p, outline_chapters(spark, d))
    t = S.toc_summary(S.dedupe_toc(toc_rows(spark, d)))
    return e.join(t, "book_id", "left")


def word_pages(spark, d):
    return partial(corpus.word_pages, spark, d)


def j4(spark, d):
    pages, words, c = corpus.pages(spark, d), word_pages(spark, d), contents(spark, d)
    o = S.toc_openers(words, S.all_toc(pages, words, c), c, headers(spark, d))
    return o.drop("line_no")


def bookmarks(spark, d, confidence=1.0):
    return S.bookmark_chapters(S.flatten_outline(corpus.outline(spark, d), corpus.books(spark, d)), confidence)


def numbered_starts(spark, d):
    """Chapter starts of two kinds: bookmarks, and headings in the running text, which are surer."""
    seen = S.body_headings(corpus.pages(spark, d)).withColumn("ord", F.col("page").cast("bigint") + 1000000)
    cols = ["book_id", "page", "number", "name", "unit", "confidence", "source", "ord"]
    return S.best_start_per_number(bookmarks(spark, d, 0.82).select(cols).unionByName(seen.select(cols)), corpus.books(spark, d))


def r5(spark, d):
    c = S.infer_chapters(corpus.books(spark, d), corpus.pages(spark, d), word_pages(spark, d), bookmarks(spark, d))
    return c.select("book_id", "start_page", "end_page", "number", "name", "unit", "confidence", "source", "chapter_key")


def w2(spark, d):
    h = S.observed_headings(corpus.pages(spark, d)).withColumn("ord", F.col("page").cast("bigint") * 100000 + F.col("line_no"))
    return S.best_start_per_page(h).select("book_id", "page", "number", "name", "unit", "confidence", "source")


def u4(spark, d):
    ids = corpus.books(spark, d).filter("book_no % 5 = 2").select("book_id")
    books = corpus.books(spark, d).filter("book_no % 7 <> 6")
    kept = S.purge_books({"pages": corpus.pages(spark, d, text=False), "contexts": contexts(spark, d)}, ids, books)
    a = kept["pages"].select("book_id", F.col("page_number").cast("string").alias("key"), F.lit("page").alias("kind"))
    return a.unionByName(kept["contexts"].select("book_id", F.col("chapter_key").alias("key"), F.lit("context").alias("kind")))


def f10_items(spark, d):
    """Memory items read from pages: two parts per chapter, some of them repeated in other case."""
    p = S.assign_chapters(corpus.pages(spark, d, text=False), chapters(spark, d))
    fields = F.element_at(F.array(*[F.lit(f) for f in X.MEMORY_LIMITS]), (F.col("doc_id") % 6 + 1).cast("int"))
    i = p.select("book_id", "chapter_key", (F.col("page_number") % 2).alias("part"), "doc_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("n"))
    key = F.expr("concat(CASE WHEN n % 2 = 0 THEN 'Item ' ELSE 'ITEM ' END, CAST((doc_id + n) % 9 AS STRING))")
    field = F.element_at(F.array(*[F.lit(f) for f in X.MEMORY_LIMITS]), ((F.col("doc_id") % 2) * 3 + F.col("n") % 3 + 1).cast("int"))
    return i.select("book_id", "chapter_key", "part", (F.col("doc_id") * 10 + F.col("n")).alias("ord"), field.alias("field"), key.alias("key"),
                    F.concat(key, F.lit(" on "), F.col("doc_id").cast("string")).alias("value"))


def f10_fold(spark, d):
    """Every page is a part of its chapter's memory; one row per kept entry."""
    p = S.assign_chapters(corpus.pages(spark, d, text=False), chapters(spark, d))
    memory = F.expr("""named_struct('kind', CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE concat('kind', doc_id % 4) END, 'topic', concat('Topic ', doc_id % 5),
      'overview', concat('View ', doc_id % 7), 'topics', array(concat('Item ', doc_id % 9), concat('ITEM ', (doc_id + 1) % 9)), 'rules', array('Rule', 'rule'),
      'concepts', array(concat('C', doc_id % 30)), 'objectives', array(), 'terms', array(concat(repeat('longer ', 20), doc_id % 3)), 'continuity', array(concat('c', doc_id % 11)),
      'characters', array(named_struct('name', concat('Ann ', doc_id % 6), 'role', concat('role ', doc_id), 'facts', 'tall', 'relations', NULL, 'pages', array(page_number, 3, NULL, page_number))),
      'activities', array(named_struct('name', 'Draw', 'purpose', concat('p', doc_id), 'alignment', 'good', 'pages', array(page_number div 3))),
      'guidance', array(named_struct('page', page_number div 2, 'expected', concat('e', doc_id), 'continuity', 'next')),
      'concerns', array(named_struct('page', page_number % 3, 'type', 'Order', 'description', concat('late ', doc_id % 4), 'evidence', concat('v', doc_id), 'confidence', 0.5D)))""")
    m = X.fold_memories(p.select("book_id", "chapter_key", F.col("page_number").alias("part"), memory.alias("memory")),
                        corpus.table(spark, d, "documents").count())

    def pages(x):
        return F.array_join(F.transform(x["pages"], lambda v: v.cast("string")), ",")

    def rows(field, line):
        return F.transform(F.col("memory")[field], lambda x, i: F.struct(F.lit(field).alias("field"), (i + 1).alias("place"), line(x).alias("value")))
    single = [F.array(F.struct(F.lit(f).alias("field"), F.lit(1).alias("place"), F.col("memory")[f].alias("value"))) for f in ("kind", "topic", "overview")]
    lists = [rows(f, lambda x: x) for f in ("topics", "rules", "concepts", "objectives", "terms", "continuity")]
    lists += [rows("characters", lambda x: F.concat_ws("|", x["name"], x["role"], x["facts"], x["relations"], pages(x))),
              rows("activities", lambda x: F.concat_ws("|", x["name"], x["purpose"], x["alignment"], pages(x))),
              rows("guidance", lambda x: F.concat_ws("|", x["page"].cast("string"), x["expected"], x["continuity"])),
              rows("concerns", lambda x: F.concat_ws("|", x["page"].cast("string"), x["type"], x["description"], x["evidence"], x["confidence"].cast("string")))]
    return m.select("book_id", "chapter_key", F.explode(F.concat(*single, *lists)).alias("r")).select("book_id", "chapter_key", "r.*")


def w13(spark, d):
    p = S.assign_chapters(corpus.pages(spark, d, text=False), chapters(spark, d))
    mem = F.expr("""named_struct('kind', 'lesson', 'topic', concat('topic  of ', chapter_name), 'overview', 'An overview.', 'topics', array('Shapes', 'shapes', concat('Page ', page_number)),
      'rules', CAST(array() AS ARRAY<STRING>), 'concepts', array('Order'), 'objectives', array('Read', 'Write'), 'terms', CAST(array() AS ARRAY<STRING>), 'continuity', CAST(array() AS ARRAY<STRING>),
      'characters', array(named_struct('name', 'Ann', 'role', 'guide', 'facts', 'tall', 'relations', 'Bob', 'pages', array(page_number, 3))),
      'activities', array(named_struct('name', 'Draw', 'purpose', 'practice', 'alignment', 'good', 'pages', array(page_number))),
      'guidance', array(named_struct('page', page_number div 2 * 2, 'expected', 'text', 'continuity', 'next')),
      'concerns', array(named_struct('page', CASE WHEN page_number % 3 = 0 THEN 0 ELSE page_number div 4 * 4 END, 'type', 'order', 'description', 'late', 'evidence', 'line 2', 'confidence', 0.5D)))""")
    r = p.withColumn("memory", mem).withColumn("title", F.col("chapter_name")).withColumn("confidence", F.col("boundary_confidence")).withColumn(
        "override", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("Use page "), "page_number")))
    return X.render_context(r).select(*PAGE, "context")


def knowledge(spark, d):
    return corpus.table(spark, d, "conversations").selectExpr(
        "concat('book-', lpad(CAST(conv_id div 7 AS STRING), 12, '0')) AS book_id", "conv_id * 100 + turn AS seq", "text",
        "CASE turn % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'page' ELSE 'chapter' END AS scope", "CAST(conv_id % 50 + 1 AS INT) AS page_number")


def j19(spark, d):
    return X.scoped_knowledge(corpus.pages(spark, d, text=False), knowledge(spark, d))


def j22(spark, d):
    fact = F.regexp_extract("message", r"(?is)^\s*(?:/remember|remember(?:\s+that)?)\s+(.+)$", 1)
    f = corpus.chat(spark, d).select(F.expr("concat('book-', lpad(CAST(conv_id div 7 AS STRING), 12, '0'))").alias("book_id"),
                                     F.expr("conv_id * 100 + turn").alias("ord"), fact.alias("text")).filter("text <> ''")
    known = corpus.books(spark, d).selectExpr("book_id", "concat('FACT ', book_no % 5) AS text")
    return X.remember_facts(known, f)


def r3_inline(spark, d):
    """Page three of each book as a contents page that was read as running text."""
    line = "concat('Contents Chapter 1: Patterns ... 1 Chapter 2: Reasoning ... 10 Chapter 3: ', text)"
    p = corpus.pages(spark, d).withColumn("text", F.expr(f"CASE WHEN page_number = 3 THEN {line} ELSE text END"))
    return S.printed_toc_inline(p)


def digest(df, col):
    return df.withColumn("chars", F.length(col).cast("bigint")).withColumn(col, F.sha2(col, 256))


QUERIES = {
    "r1_body_headings": lambda s, d: S.body_headings(corpus.pages(s, d)),
    "r2_observed_headings": lambda s, d: S.observed_headings(corpus.pages(s, d), word_pages(s, d)),
    "r3_printed_toc": lambda s, d: S.printed_toc(corpus.pages(s, d)).select("book_id", "number", "title", "printed_page"),
    "r3_printed_toc_inline": r3_inline,
    "r4_flatten_outline": lambda s, d: S.flatten_outline(corpus.outline(s, d), corpus.books(s, d)).drop("place"),
    "r5_infer_chapters": r5,
    "r6_refresh_contexts": lambda s, d: X.refresh_contexts(chapters(s, d), corpus.pages(s, d), contexts(s, d)),
    "j1_assign_chapters": lambda s, d: S.assign_chapters(corpus.pages(s, d, text=False), chapters(s, d)).select(*PAGE, "chapter_key"),
    "j2_expected_chapter": j2,
    "j3_pair_toc_columns": lambda s, d: S.pair_toc_columns(word_pages(s, d), contents(s, d)).drop("label"),
    "j4_toc_openers": j4,
    "w1_chapter_bounds": lambda s, d: chapters(s, d).select("book_id", "start_page", "end_page", "name", "source", "chapter_key"),
    "w1_numbered_bounds": lambda s, d: S.numbered_bounds(corpus.books(s, d), numbered_starts(s, d)),
    "w2_best_start_per_page": w2,
    "w2_best_start_per_number": lambda s, d: numbered_starts(s, d).select("book_id", "page", "number", "name", "unit", "confidence", "source"),
    "w3_running_unit": lambda s, d: S.running_unit(corpus.pages(s, d, text=False), headers(s, d)),
    "c9_sparse_chapter": lambda s, d: X.sparse_chapter(corpus.pages(s, d), chapters(s, d)).withColumn("avg_chars", F.round("avg_chars", 6)),
    "f6_token_usage": lambda s, d: X.token_usage(corpus.pages(s, d, text=False), chapters(s, d)),
    "f6_chapter_status": lambda s, d: X.chapter_status(contexts(s, d)),
    "f10_merge_memories": lambda s, d: X.merge_memories(f10_items(s, d)),
    "f10_fold_memories": f10_fold,
    "f11_chapter_source": lambda s, d: X.chapter_source(corpus.pages(s, d), chapters(s, d)),
    "f12_evidence_hash": lambda s, d: X.evidence_hash(corpus.pages(s, d)),
    "f13_structure_status": lambda s, d: S.structure_status(corpus.books(s, d), chapters(s, d), corpus.pages(s, d)),
    "f14_chapter_coverage": lambda s, d: X.chapter_coverage(corpus.pages(s, d), chapters(s, d), contexts(s, d)),
    "f16_dedupe_toc": lambda s, d: S.dedupe_toc(toc_rows(s, d)).drop("ord"),
    "f16_u2_merge_units": lambda s, d: S.merge_units(headers(s, d), S.flatten_outline(corpus.outline(s, d), corpus.books(s, d))),
    "j19_scoped_knowledge": j19, "j22_remember_facts": j22,
    "j21_stale_contexts": lambda s, d: X.stale_contexts(contexts(s, d), chapters(s, d)).select("book_id", "chapter_key", "status"),
    "u4_purge_books": u4,
    "w11_local_context": lambda s, d: digest(X.local_context(corpus.pages(s, d), chapters(s, d)), "context"),
    "w12_split_chapter": lambda s, d: digest(X.split_chapter(corpus.pages(s, d), chapters(s, d)), "text"),
    "w13_render_context": w13,
}
