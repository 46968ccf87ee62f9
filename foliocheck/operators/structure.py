"""Book structure: headings, printed contents, openers, chapters and their pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliocheck import constants as C
from foliocheck.session import cut_lineage
from foliocheck.functions import digits as N, text as T
from foliocheck.operators import layout_rules as LR, streams as ST

PAGE = ["book_id", "page_number"]


def body_headings(pages: DataFrame) -> DataFrame:
    """`Chapter n: name` near the top of a page that is not a contents page."""
    top = T.squash_head(F.col("text"), 500)
    contents = top.rlike(r"(?i)" + C.WB + r"(?:table\s+of\s+contents|contents|index|विषय[ -]?सूची)" + C.WE)
    hit = F.regexp_extract("top", C.P_BODY_HEADING, 0)
    p = pages.select(*PAGE, top.alias("top"), contents.alias("contents")).filter("NOT contents")
    p = p.withColumn("hit", hit).filter("hit <> ''").filter(F.instr("top", F.col("hit")) - 1 <= 180)
    name = F.regexp_replace(T.squash(F.regexp_extract("hit", C.P_BODY_HEADING, 2)), r"\s{2,}.*", "")
    return p.select("book_id", N.number(F.regexp_extract("hit", C.P_BODY_HEADING, 1)).alias("number"),
                    F.substring(name, 1, 90).alias("name"), F.col("page_number").alias("page"), F.lit("").alias("unit"),
                    F.lit(0.92).alias("confidence"), F.lit("body_heading").alias("source"), F.lit("pdf").alias("page_numbering")).filter("number IS NOT NULL")


def heading_lines(pages: DataFrame) -> DataFrame:
    """Unit and chapter lines with what they say, contents pages included."""
    lines = pages.select(*PAGE, T.is_contents_page(F.col("text")).alias("contents"),
                         F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^[|¦\s]+", "")).filter(F.col("line").rlike(C.P_LINE_HEADING))
    part = lambda i: F.regexp_extract("line", C.P_LINE_HEADING, i)
    name = T.strip(part(3))
    unit = F.when(F.lower(part(1)) == "unit", F.concat(F.lit("Unit "), N.plain(part(2)), F.lit(": "), name)).otherwise("")
    return lines.select(*PAGE, "line_no", "contents", N.number(part(2)).alias("number"), name.alias("name"), unit.alias("unit")).filter("number IS NOT NULL")


def observed_headings(pages: DataFrame, words: ST.Words | None = None) -> DataFrame:
    """Headings that open a unit or chapter. With words, a page that has any must show a heading
    word in its upper third. A unit number seen before is a running header."""
    h = heading_lines(pages)
    if words is not None and ST.is_pages(words):
        opens = F.exists("words", lambda w: (w["ymin"] < 330) & w["str"].rlike("(?i)^(?:unit|chapter|ch)"))
        laid_out = ST.pages_beside(words, h.select(*PAGE).distinct()).select(*PAGE, opens.alias("shown"))
        h = h.join(laid_out, PAGE, "left").filter("shown IS NULL OR shown")
    elif words is not None:
        laid_out = words.select(*PAGE).distinct().withColumn("has_words", F.lit(True))
        shown = words.filter((F.col("ymin") < 330) & F.col("str").rlike("(?i)^(?:unit|chapter|ch)")).select(*PAGE).distinct().withColumn("shown", F.lit(True))
        h = h.join(laid_out.join(h.select(*PAGE).distinct(), PAGE, "left_semi"), PAGE, "left").join(shown, PAGE, "left")
        h = h.filter("has_words IS NULL OR shown")
    h = h.filter("NOT contents")
    is_unit = F.col("unit") != ""
    nth = F.row_number().over(W.partitionBy("book_id", is_unit, "number").orderBy("page_number", "line_no"))
    h = h.withColumn("nth", nth).filter(~is_unit | (F.col("nth") == 1))
    first = F.row_number().over(W.partitionBy(*PAGE, "name").orderBy("line_no"))
    return h.withColumn("first", first).filter("first = 1").select(
        "book_id", F.col("page_number").alias("page"), "line_no", "number", "name", "unit",
        F.when(is_unit, 0.55).otherwise(0.8).alias("confidence"), F.when(is_unit, "unit_heading").otherwise("body_heading").alias("source"))


def printed_toc(pages: DataFrame) -> DataFrame:
    """Lines `n title page` of contents pages; a printed number is no position."""
    lines = pages.filter(T.is_contents_page(F.col("text"))).select(*PAGE, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    part = lambda i: F.regexp_extract("line", C.P_TOC_LINE, i)
    t = lines.filter(F.col("line").rlike(C.P_TOC_LINE)).select(
        "book_id", "page_number", "line_no", N.number(part(1)).alias("number"), T.strip(part(2)).alias("title"), N.number(part(3), "int").alias("printed_page"))
    t = t.filter("number IS NOT NULL AND printed_page IS NOT NULL")
    rn = F.row_number().over(W.partitionBy("book_id", "title", "printed_page").orderBy("page_number", "line_no"))
    return t.withColumn("rn", rn).filter("rn = 1").drop("rn")


P_TOC_UNIT = r"(?i)(?:Unit|इकाई)\s*(\d+|[IVXLCDM]+)[\s:.-]+([A-Za-z0-9\s,\-’'()]+?)(?=(?:Chapter|Unit|इकाई|\d+\.|$))"
P_TOC_INLINE = (r"(?i)(?:Chapter|अध्याय)?\s*(\d+)\s*[:.-]\s*([A-Za-z0-9\s,\-’'()]+?)\s*(?:\.{2,}|…)?\s*(\d{1,4})"
                r"(?=\s*(?:Chapter|अध्याय|\d+\s*[:.-]|$))")


def printed_toc_inline(pages: DataFrame, front: int = 15) -> DataFrame:
    """Chapters of a contents page that was read as running text, on the first pages of a book."""
    p = pages.filter((F.col("page_number") <= front) & T.is_contents_page(F.col("text"), "printed"))
    hits = p.select(*PAGE, F.posexplode(F.regexp_extract_all("text", F.lit(P_TOC_INLINE), F.lit(0))).alias("n", "hit"))
    # The look-ahead needs what follows, so the parts are cut from the match without it.
    cut = P_TOC_INLINE[:P_TOC_INLINE.index("(?=")] + r"\s*$"
    part = lambda i: F.regexp_extract("hit", cut, i)
    t = hits.select(*PAGE, "n", N.number(part(1)).alias("number"), T.strip(part(2)).alias("title"), N.number(part(3), "int").alias("printed_page"))
    return t.filter(F.col("number").isNotNull() & (F.length("title") > 2) & (F.col("printed_page") > 0))


def pair_toc_columns(words: ST.Words, contents: DataFrame) -> DataFrame:
    """Contents rows from measured baselines: a number at the right edge with the title words to
    its left and, where present, the row number. `contents`: page keys of contents pages."""
    if ST.is_pages(words):
        words = ST.word_rows(ST.pages_beside(words, contents.select(*PAGE).distinct()))
    w = words.join(contents.select(*PAGE), PAGE, "left_semi").filter(~F.coalesce(LR.weak(), F.lit(False)) | (F.col("xmin") < 100))
    mid = (F.col("ymin") + F.col("ymax")) / 2
    label = w.filter((F.col("xmin") > 700) & F.col("str").rlike(r"^\d{1,3}$")).select(
        *PAGE, F.col("word_idx").alias("label"), F.col("str").cast("int").alias("printed_page"), F.col("xmin").alias("l_x"), mid.alias("l_mid"),
        F.greatest(F.lit(8.0), (F.col("ymax") - F.col("ymin")) * 0.6).alias("reach"))
    body = w.filter(F.col("xmin") >= 100).select(*PAGE, "word_idx", "str", "xmin", "xmax", mid.alias("mid"))
    rows = label.join(body, PAGE).filter("xmax < l_x - 30 AND abs(mid - l_mid) < reach")
    rows = rows.groupBy(*PAGE, "label", "printed_page", "l_mid").agg(F.array_sort(F.collect_list(F.struct("xmin", "word_idx", "str"))).alias("t"))
    title = F.trim(F.regexp_replace(F.array_join(F.transform("t", lambda x: x["str"]), " "), r"^\d+[.:]?\s+", ""))
    rows = rows.withColumn("title", title).filter((F.length("title") >= 3) & ~F.col("title").rlike(r"(?i)^(?:Unit|Chapter|Ch[.])" + C.WE))
    nums = w.filter((F.col("xmin") < 100) & F.col("str").rlike(r"^\d+[.:]?$")).select(*PAGE, F.col("word_idx").alias("n_idx"), F.col("str").alias("n_str"), mid.alias("n_mid"))
    near = rows.select(*PAGE, "label", "l_mid").join(nums, PAGE).filter("abs(n_mid - l_mid) < 10")
    near = near.groupBy(*PAGE, "label").agg(F.min_by("n_str", "n_idx").alias("n_str"))
    out = rows.join(near, [*PAGE, "label"], "left")
    out = out.select(*PAGE, "label", F.coalesce(N.number(F.regexp_replace("n_str", r"\D", "")), F.lit(0)).alias("number"), "title", "printed_page")
    rn = F.row_number().over(W.partitionBy("book_id", F.lower("title"), "printed_page").orderBy("page_number", "label"))
    return out.withColumn("rn", rn).filter("rn = 1").drop("rn")


def toc_openers(words: ST.Words, toc: DataFrame, contents: DataFrame, unit_headers: DataFrame) -> DataFrame:
    """Pages that open a printed chapter: a large line near the top that says its title."""
    lines = LR.page_lines(words, large=(1.4, 330)).withColumn("name", T.strip(F.regexp_replace("text", r"^[|¦\s]+", ""))).filter(
        (F.col("y") <= 330) & (F.col("height") >= F.col("median") * 1.4) & ~F.col("weak"))
    lines = lines.join(contents.select(*PAGE), PAGE, "left_anti")
    entry = toc.groupBy("book_id", F.lower("title").alias("key")).agg(F.min_by("number", F.struct("page_number", "ord")).alias("number"))
    hit = lines.withColumn("key", F.lower("name")).join(entry, ["book_id", "key"])
    first = F.row_number().over(W.partitionBy("book_id", "key").orderBy("page_number", "first"))
    hit = hit.withColumn("rn", first).filter("rn = 1").select("book_id", F.col("page_number").alias("page"), "number", "name")
    u = unit_headers.select("book_id", F.col("page").alias("u_page"), F.col("line_no").alias("u_line"), F.col("unit").alias("u_unit"))
    units = (hit.select("book_id", "page").join(u, "book_id").filter("u_page <= page").groupBy("book_id", "page")
             .agg(F.max_by("u_unit", F.struct("u_page", "u_line")).alias("unit")))
    return hit.join(units, ["book_id", "page"], "left").select(
        "book_id", "page", F.lit(0).alias("line_no"), "number", "name", F.coalesce("unit", F.lit("")).alias("unit"),
        F.lit(0.95).alias("confidence"), F.lit("toc_opener").alias("source"))


def best_start_per_page(candidates: DataFrame) -> DataFrame:
    """Highest confidence per page, the first one on ties (`ord`)."""
    rn = F.row_number().over(W.partitionBy("book_id", "page").orderBy(F.col("confidence").desc(), "ord"))
    return candidates.withColumn("rn", rn).filter("rn = 1").drop("rn")


def chapter_key(page: Column, name: Column) -> Column:
    return F.concat(F.lit("chapter-"), page.cast("string"), F.lit("-"),
                    F.substring(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), 1, 70))


def chapter_bounds(books: DataFrame, starts: DataFrame) -> DataFrame:
    """Chapters that tile every book: each ends before the next, front matter fills the gap at
    the start, and a book without any start is one unclassified chapter."""
    cols = ["book_id", "page", "number", "name", "unit", "confidence", "source"]
    first = starts.groupBy("book_id").agg(F.min("page").alias("first_page"))
    lead_in = (books.select("book_id").join(first, "book_id", "left").filter("first_page IS NULL OR first_page > 1").select(
        "book_id", F.lit(1).alias("page"), F.lit(0).cast("bigint").alias("number"),
        F.when(F.col("first_page").isNull(), "Unclassified content").otherwise("Front matter").alias("name"), F.lit("").alias("unit"),
        F.lit(0.2).alias("confidence"), F.when(F.col("first_page").isNull(), "book_fallback").otherwise("front_matter").alias("source")))
    c = starts.select(cols).unionByName(lead_in).join(books.select("book_id", "page_count"), "book_id")
    nxt = F.lead("page").over(W.partitionBy("book_id").orderBy("page"))
    return c.withColumn("start_page", F.col("page")).withColumn("end_page", F.coalesce(nxt - 1, F.col("page_count"))).withColumn(
        "chapter_key", chapter_key(F.col("page"), F.col("name"))).drop("page_count")


def infer_chapters(books: DataFrame, pages: DataFrame, words: ST.Words | None = None, bookmarks: DataFrame | None = None) -> DataFrame:
    """Chapters of every book from observed headings and, with words, printed contents and openers, and, with `bookmarks` (of `bookmark_chapters`), from those."""
    seen = observed_headings(pages, words)
    order = F.col("page").cast("bigint") * 100000 + F.col("line_no")
    cand = seen.withColumn("ord", order)
    if words is not None:
        contents = pages.filter(T.is_contents_page(F.col("text"))).select(*PAGE)
        opened = toc_openers(words, all_toc(pages, words, contents), contents, seen.filter("unit <> ''"))
        cand = cand.unionByName(opened.withColumn("ord", order + 100000000000))
    if bookmarks is not None:
        cand = cand.unionByName(bookmarks.withColumn("ord", F.col("ord") - 100000000000), allowMissingColumns=True)
    return chapter_bounds(books, best_start_per_page(cand))


def all_toc(pages: DataFrame, words: ST.Words, contents: DataFrame) -> DataFrame:
    """Printed contents rows of both kinds, measured columns first, each title and page once."""
    cols = pair_toc_columns(words, contents).select("book_id", "page_number", F.col("label").cast("bigint").alias("ord"), "number", "title", "printed_page")
    lines = printed_toc(pages).select("book_id", "page_number", (F.col("line_no") + 1000000000).cast("bigint").alias("ord"), "number", "title", "printed_page")
    both = cols.unionByName(lines)
    rn = F.row_number().over(W.partitionBy("book_id", F.lower("title"), "printed_page").orderBy("page_number", "ord"))
    return both.withColumn("rn", rn).filter("rn = 1").drop("rn")


def structure_status(books: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    indexed = pages.groupBy("book_id").agg(F.count_if(T.is_indexed(F.col("evidence_indexed"), F.col("text"))).alias("indexed"))
    weak = chapters.groupBy("book_id").agg(F.bool_or((F.col("confidence") < 0.6) & (F.col("source") != "front_matter")).alias("uncertain"))
    j = books.select("book_id", "page_count").join(indexed, "book_id", "left").join(weak, "book_id", "left")
    return j.select("book_id", "page_count", F.coalesce("indexed", F.lit(0)).alias("indexed"), F.when(
        F.coalesce("indexed", F.lit(0)) < F.col("page_count"), "partial").when(F.coalesce("uncertain", F.lit(False)), "degraded").otherwise("ready").alias("status"))


def assign_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapter of every page: an equi-join on the book, the page range decides."""
    c = chapters.select("book_id", "chapter_key", "start_page", "end_page", F.col("name").alias("chapter_name"), F.col("confidence").alias("boundary_confidence"))
    p = pages.drop("chapter_key") if "chapter_key" in pages.columns else pages
    return p.join(c, "book_id").filter("page_number BETWEEN start_page AND end_page")


def expected_chapter(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Last chapter observed at or before each page; printed positions are never used."""
    c = chapters.filter("page_numbering = 'pdf' AND page > 0")
    title = F.coalesce("title", F.concat(F.lit("Chapter "), F.col("number").cast("string"), F.lit(": "), F.col("name")))
    marks = c.select("book_id", F.col("page").alias("page_number"), F.struct(title.alias("title"), F.coalesce("unit", F.lit("")).alias("unit")).alias("c"), F.lit(0).alias("kind"), "ord")
    rows = pages.select(*PAGE).withColumn("kind", F.lit(1)).withColumn("ord", F.lit(0).cast("bigint"))
    u = marks.unionByName(rows, allowMissingColumns=True)
    w = W.partitionBy("book_id").orderBy("page_number", "kind", "ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    u = u.withColumn("last", F.last("c", ignorenulls=True).over(w)).filter("kind = 1")
    return u.select(*PAGE, F.coalesce("last.title", F.lit("")).alias("expected_chapter"), F.coalesce("last.unit", F.lit("")).alias("expected_unit"))


def toc_summary(toc: DataFrame, limit: int = 10) -> DataFrame:
    """The first entries of a book's contents with what kind of page number they carry."""
    place = F.when(F.col("page_numbering") == "pdf", F.concat(F.lit(" (PDF pg "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(")"))).otherwise(
        F.concat(F.lit(" (printed pg "), F.coalesce(F.col("printed_page").cast("string"), F.col("page").cast("string"), F.lit("?")), F.lit("; PDF position unverified)")))
    t = toc.withColumn("rn", F.row_number().over(W.partitionBy("book_id").orderBy("ord"))).filter(F.col("rn") <= limit)
    g = t.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat("title", place).alias("s")))).alias("l"))
    return g.select("book_id", F.array_join(F.transform("l", lambda x: x["s"]), "; ").alias("toc_summary"))


def running_unit(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """The last unit header at or before each page."""
    h = headers.filter("unit <> ''").select("book_id", F.col("page").alias("page_number"), "unit", F.lit(0).alias("kind"), "line_no")
    rows = pages.select(*PAGE).withColumn("kind", F.lit(1)).withColumn("line_no", F.lit(0))
    u = h.unionByName(rows, allowMissingColumns=True)
    w = W.partitionBy("book_id").orderBy("page_number", "kind", "line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return u.withColumn("u", F.last("unit", ignorenulls=True).over(w)).filter("kind = 1").select(*PAGE, F.coalesce("u", F.lit("")).alias("unit"))


def outline_paths(outline: DataFrame) -> DataFrame:
    """Every bookmark with its path from the root, whose order is the reading order, its unit, and why it has no place, if so.

    A unit title covers its later siblings and all that lies below them. Paths grow by doubling: each round a row takes over the path, the unit and
    the parent of the row it hangs on, so a tree of depth d takes log2(d) joins. (A recursive query would stop at a million rows of all books.)
    `reject` is `no parent` under a bookmark that does not exist and `cycle` for bookmarks that hang on themselves and all below them.
    """
    title = T.strip(F.coalesce("title", F.lit("")))
    scope = W.partitionBy("book_id", "parent_id").orderBy("ord", "node_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.concat(*[F.lpad((F.col(c).cast("bigint") + 2147483648).cast("string"), 10, "0") for c in ("ord", "node_id")])
    rows = outline.select("book_id", "node_id", title.alias("title"), "page", F.col("parent_id").alias("up"), step.alias("step"), step.alias("path"),
                          F.last(F.when(title.rlike(r"(?i)^(?:Unit\b|इकाई)"), title), ignorenulls=True).over(scope).alias("unit"))
    there = outline.select("book_id", F.col("node_id").alias("up"), F.lit(True).alias("there")).distinct()
    rows = rows.join(there, ["book_id", "up"], "left").withColumn(
        "reject", F.when(F.col("up").isNotNull() & F.col("there").isNull(), "no parent").when(F.col("up") == F.col("node_id"), "cycle")).drop("there")
    while True:
        rows = cut_lineage(rows)
        if rows.filter("up IS NOT NULL AND reject IS NULL").isEmpty():
            return rows.drop("up", "step")
        above = rows.select("book_id", F.col("node_id").alias("up"), F.col("path").alias("up_path"), F.col("unit").alias("up_unit"), F.col("up").alias("up_up"), F.col("reject").alias("up_reject"))
        open_ = F.col("reject").isNull() & F.col("up_path").isNotNull()
        again = F.array_contains(F.split("up_path", "/"), F.col("step"))
        rows = rows.join(above, ["book_id", "up"], "left").select(
            "book_id", "node_id", "title", "page", "step", F.when(open_, F.col("up_up")).otherwise(F.col("up")).alias("up"),
            F.when(open_ & ~again, F.concat_ws("/", "up_path", "path")).otherwise(F.col("path")).alias("path"),
            F.when(open_, F.coalesce("unit", "up_unit")).otherwise(F.col("unit")).alias("unit"),
            F.coalesce("reject", F.when(open_ & again, "cycle"), "up_reject").alias("reject"))


def flatten_outline(outline: DataFrame, books: DataFrame) -> DataFrame:
    """Bookmarks in reading order with their unit; `number` and `name` are set for chapters whose page exists. Bookmarks without a title or a place in
    the tree are left out; `outline_rejects` lists the latter."""
    order = W.partitionBy("book_id").orderBy("path")
    flat = outline_paths(outline).filter("reject IS NULL AND title <> ''").withColumn("place", F.row_number().over(order) - 1)
    j = flat.withColumn("unit", F.coalesce("unit", F.lit(""))).join(books.select("book_id", "page_count"), "book_id")
    page = F.when(F.col("page").between(1, F.col("page_count")), F.col("page"))
    pattern = r"(?i)^(?:Chapter|अध्याय)\s*(\d+|[IVXLCDM]+)\s*[:.-]?\s*(.*)$"
    chapter = page.isNotNull() & F.col("title").rlike(pattern)
    return j.select("book_id", "place", "node_id", "title", page.alias("page"), "unit",
                    F.when(chapter, F.regexp_extract("title", pattern, 1)).alias("number"), F.when(chapter, F.regexp_extract("title", pattern, 2)).alias("name"))


def outline_rejects(outline: DataFrame) -> DataFrame:
    """Bookmarks that hang on none that exists, or on themselves."""
    return outline_paths(outline).filter("reject IS NOT NULL").select("book_id", "node_id", "title", "reject")


def bookmark_chapters(flat: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Chapters that the bookmarks name, as starts. A bookmark decides over anything that is seen on its page; Roman numbers count as unnumbered."""
    return flat.filter("name IS NOT NULL").select(
        "book_id", "page", F.lit(0).alias("line_no"), F.coalesce(N.number(F.col("number")), F.lit(0)).cast("bigint").alias("number"), "name", "unit",
        F.lit(confidence).alias("confidence"), F.lit("bookmark").alias("source"), F.col("place").cast("bigint").alias("ord"))


def best_start_per_number(starts: DataFrame, books: DataFrame) -> DataFrame:
    """One start for each chapter number of a book, or for each name and page where there is no number: the highest confidence, the first on ties
    (`ord`). Pages outside the book do not count."""
    s = starts.join(books.select("book_id", "page_count"), "book_id").filter("page BETWEEN 1 AND page_count").drop("page_count")
    number = F.coalesce("number", F.lit(0))
    key = F.when(number != 0, number.cast("string")).otherwise(F.concat(T.slug(F.col("name")), F.lit("-"), F.col("page").cast("string")))
    rn = F.row_number().over(W.partitionBy("book_id", key).orderBy(F.col("confidence").desc(), "ord"))
    return s.withColumn("rn", rn).filter("rn = 1").drop("rn")


def numbered_bounds(books: DataFrame, starts: DataFrame) -> DataFrame:
    """Chapters from one start per number: each lasts to the page before the next, one page at least; a book without starts is one chapter."""
    none = books.join(starts.select("book_id").distinct(), "book_id", "left_anti").select(
        "book_id", F.lit(1).alias("page"), F.lit(1).cast("bigint").alias("number"), F.lit("Unclassified book content").alias("name"), F.lit("").alias("unit"),
        F.lit(0.2).alias("confidence"), F.lit("book_fallback").alias("source"), F.lit(0).cast("bigint").alias("ord"))
    c = starts.select(none.columns).unionByName(none).join(books.select("book_id", "page_count"), "book_id")
    order = W.partitionBy("book_id").orderBy("page", "ord")
    slug = T.slug(F.col("name"))
    c = c.withColumns({"next": F.lead("page").over(order), "turn": F.row_number().over(order)})
    return c.select("book_id", F.col("page").alias("start_page"), F.when(F.col("next").isNull(), F.col("page_count")).otherwise(F.greatest("page", F.col("next") - 1)).alias("end_page"), "number", "name", "unit", "confidence", "source",
                    F.concat_ws("-", F.lit("chapter"), F.when(F.coalesce("number", F.lit(0)) != 0, F.col("number")).otherwise(F.col("turn")).cast("string"),
                                F.when(slug != "", slug).otherwise(F.col("page").cast("string"))).alias("chapter_key"))


def dedupe_toc(toc: DataFrame) -> DataFrame:
    """Contents rows once per title, numbering and page, first seen first."""
    place = F.coalesce("page", "printed_page")
    rn = F.row_number().over(W.partitionBy("book_id", "title", "page_numbering", place).orderBy("ord"))
    return toc.withColumn("rn", rn).filter("rn = 1").drop("rn")


def merge_units(*units: DataFrame) -> DataFrame:
    out = units[0].select("book_id", "unit")
    for u in units[1:]:
        out = out.union(u.select("book_id", "unit"))
    return out.filter("unit <> ''").distinct()


def purge_books(tables: dict[str, DataFrame], ids: DataFrame, books: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of deleted books and without orphans whose book is gone."""
    live = books.select("book_id").join(ids.select("book_id"), "book_id", "left_anti")
    return {name: df.join(live, "book_id", "left_semi") for name, df in tables.items()}
