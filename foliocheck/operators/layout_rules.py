"""Lines of a page and the rules that need measured positions."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliocheck import constants as C
from foliocheck.operators import streams as ST
from foliocheck.session import ship_package

PAGE = ["book_id", "page_number"]


Field = Callable[[str], Column]


def line_key(native: Column, of: Field = F.col) -> Column:
    ids = F.concat_ws(":", F.coalesce(of("block_id"), F.lit("")), F.coalesce(of("paragraph_id"), F.lit("")), of("line_id"))
    return F.when(F.coalesce(of("line_id"), F.lit("")) != "", ids).otherwise(native)


def by_tenth(of: Field = F.col) -> Column:
    """Lines of native words: rows of ten units, left and right halves apart."""
    return F.concat(F.floor(of("ymin") / 10 + 0.5).cast("string"), F.when(of("xmin") < 500, ":left").otherwise(":right"))


def weak(of: Field = F.col) -> Column:
    return (of("source") == "ocr_text") & (of("confidence") < 0.8)


def layout_transcript(words: DataFrame) -> DataFrame:
    """Page text by lines: words from left to right, lines in the order they were first seen."""
    h = F.col("ymax") - F.col("ymin")
    native = F.concat(F.lit("native:"), F.floor(F.col("ymin") / F.greatest(F.lit(5.0), h) + 0.5).cast("string"))
    native = F.when(F.coalesce("block_id", F.lit("")) != "", F.concat(F.col("block_id"), F.substring(native, 7, 100))).otherwise(native)
    g = (words.withColumn("line", line_key(native)).groupBy(*PAGE, "line")
         .agg(F.array_sort(F.collect_list(F.struct("xmin", "word_idx", "str"))).alias("w"), F.min("word_idx").alias("first")))
    g = g.select(*PAGE, "first", F.array_join(F.transform("w", lambda x: x["str"]), " ").alias("t"))
    return (g.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("first", "t"))).alias("l"))
            .select(*PAGE, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("transcript")))


def _pages_with_large(words: ST.Words, share: float, depth: float) -> DataFrame:
    """Word rows, with the median height of their page, of the pages where a word no lower than `depth` is so much taller than the median."""
    pages = ST.page_words(words)
    tall = lambda w: w["ymax"] - w["ymin"]
    heights = F.sort_array(F.filter(F.transform("words", tall), lambda h: h > 0))
    # Of an even number the upper one, as below.
    pages = pages.withColumn("heights", heights).withColumn("median", F.expr("get(heights, size(heights) div 2)")).drop("heights")
    # The tallest word alone meets the median: inside a test of each word all heights would be sorted again for each.
    tallest = F.array_max(F.transform(F.filter("words", lambda w: w["ymin"] <= depth), tall))
    pages = pages.filter(tallest >= F.coalesce("median", F.lit(15.0)) * share)
    return ST.word_rows(pages, "median").repartition(*PAGE)


def page_lines(words: ST.Words, large: tuple[float, float] | None = None) -> DataFrame:
    """Line rows with their text and measures, and the upper median word height of the page.

    One pass: the median is taken over the page before words are grouped into lines. `large` (share, depth) leaves out pages without any line that is
    so much taller than the median and begins no lower than `depth`.
    """
    if ST.is_pages(words):
        words = _pages_with_large(words, *large) if large else ST.word_rows(ST.page_words(words))
    page = "OVER (PARTITION BY book_id, page_number)"
    words = words.withColumn("h", F.col("ymax") - F.col("ymin")).withColumn("line", line_key(by_tenth()))
    if "median" not in words.columns:
        # The discrete median from the top is the upper one.
        words = words.withColumn("median", F.expr(
            f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN h > 0 THEN h END DESC) {page}"))
    lines = words.groupBy(*PAGE, "line").agg(
        F.array_sort(F.collect_list(F.struct("xmin", "word_idx", "str", "text_start", "text_end", "block_id"))).alias("w"),
        F.min("word_idx").alias("first"), F.min("ymin").alias("y"), F.min("h").alias("height"), F.min("xmin").alias("xmin"),
        F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count("*").alias("n_words"),
        F.bool_or(F.coalesce(weak(), F.lit(False))).alias("weak"), F.max("median").alias("median"),
        F.bool_and(F.coalesce(F.col("role") == "heading", F.lit(False))).alias("banner"),
        F.bool_and(F.col("source") == "ocr_text").alias("all_ocr"))
    lines = lines.select(
        *PAGE, "line", "first", F.array_join(F.transform("w", lambda x: x["str"]), " ").alias("text"), "y", "height",
        F.get("w", F.lit(0))["xmin"].alias("x"), "xmin", "xmax", "ymax", "n_words", "weak", "banner", "all_ocr",
        F.get("w", F.lit(0))["text_start"].alias("text_start"), F.element_at("w", -1)["text_end"].alias("text_end"),
        F.coalesce(F.get("w", F.lit(0))["block_id"], F.lit("")).alias("block"), F.coalesce("median", F.lit(15.0)).alias("median"))
    return lines.withColumn("block_words", F.sum("n_words").over(W.partitionBy(*PAGE, "block")))


#: Words of the longest heading with a small letter, or label.
SHORT = 5
_LINES = "struct<median:double,lines:array<struct<at:array<int>,block_words:bigint>>>"


def _short_lines(x: pa.Array, y: pa.Array, bottom: pa.Array, key: pa.Array, block: pa.Array, said: pa.Array) -> pa.Array:
    """Upper median word height of each page and its lines of at most `SHORT` words, each with how many words its block has. Lines of a page whose words
    have no keys are those of `by_tenth`; `said` tells which words have a text."""
    sizes = x.value_lengths().fill_null(0).to_numpy()
    n, page = len(sizes), np.repeat(np.arange(len(sizes)), sizes)

    def flat(lists: pa.Array) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=False).astype(float)

    def coded(names: pa.Array) -> np.ndarray:
        return names.flatten().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    left, top = flat(x), flat(y)
    line = np.floor(top / 10 + 0.5) * 2 + (left >= 500) if key.null_count == n else coded(key)
    order = np.lexsort((left, line, page))
    new = (np.diff(page[order], prepend=-1) != 0) | (np.diff(line[order], prepend=np.nan) != 0)
    starts = np.flatnonzero(new)
    words = np.diff(np.append(starts, len(order)))
    of = page[order[starts]]
    group = of if block.null_count == n else np.unique(of * (len(order) + 2) + coded(block)[order[starts]] + 1, return_inverse=True)[1]
    in_block = np.bincount(group, words)[group].astype(np.int64) if len(of) else np.zeros(0, np.int64)
    texts = words if said.null_count == n else np.add.reduceat(flat(said)[order], starts) if len(of) else words
    short = np.flatnonzero(texts <= SHORT)
    places = order[np.repeat(texts <= SHORT, words)]
    before = np.cumsum(sizes) - sizes

    def bounds(counts: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    at = pa.ListArray.from_arrays(bounds(words[short]), pa.array((places - before[page[places]]).astype(np.int32)))
    lines = pa.StructArray.from_arrays([at, pa.array(in_block[short])], ["at", "block_words"])
    height = flat(bottom) - top
    tall = np.flatnonzero(height > 0)
    tall = tall[np.lexsort((height[tall], page[tall]))]
    counts = np.bincount(page[tall], minlength=n)
    median = np.full(n, np.nan)
    some = counts > 0
    # Of an even number the upper one.
    median[some] = height[tall[(np.cumsum(counts) - counts + counts // 2)[some]]]
    return pa.StructArray.from_arrays([pa.array(median, mask=~some), pa.ListArray.from_arrays(bounds(np.bincount(of[short], minlength=n)), lines)], ["median", "lines"])


def short_lines(words: ST.Words) -> DataFrame:
    """Pages with their lines of at most `SHORT` words, measured as by `page_lines`, made where the words of the page are."""
    if ST.is_pages(words):
        given = words() if callable(words) else words
    else:
        fields = ["word_idx", "str", "xmin", "ymin", "xmax", "ymax", "source", "confidence", "text_start", "text_end", "block_id", "paragraph_id", "line_id", "role"]
        given = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("words"))
    ship_package(given.sparkSession)

    def field(w: Column) -> Field:
        return lambda name: ST.field(given, w, name)
    there = given.schema["words"].dataType.elementType.fieldNames()
    named = "line_id" in there
    none = F.lit(None)
    key = F.transform("words", lambda w: line_key(by_tenth(field(w)), field(w))) if named else none.cast("array<string>")
    said = F.transform("words", lambda w: F.coalesce(F.trim(w["str"]) != "", F.lit(False)).cast("int")) if named else none.cast("array<int>")
    block = F.transform("words", lambda w: F.coalesce(w["block_id"], F.lit(""))) if "block_id" in there else none.cast("array<string>")
    found = F.arrow_udf(_short_lines, _LINES).asNondeterministic()("words.xmin", "words.ymin", "words.ymax", key, block, said)
    pages = given.select(*PAGE, "words", found.alias("found")).filter(F.size("found.lines") > 0)

    def line(l: Column) -> Column:
        return F.struct(F.transform(l["at"], lambda i: F.get("words", i)).alias("w"), l["block_words"].alias("block_words"))

    def measured(l: Column) -> Column:
        w = l["w"]
        return F.struct(
            F.array_join(w["str"], " ").alias("text"), F.array_min(w["word_idx"]).alias("first"), F.array_min(w["ymin"]).alias("y"),
            F.array_min(F.transform(w, lambda v: v["ymax"] - v["ymin"])).alias("height"), F.get(w, F.lit(0))["xmin"].alias("x"), F.array_min(w["xmin"]).alias("xmin"),
            F.array_max(w["xmax"]).alias("xmax"), F.array_max(w["ymax"]).alias("ymax"), F.size(w).cast("bigint").alias("n_words"), l["block_words"].alias("block_words"),
            F.exists(w, lambda v: F.coalesce(weak(field(v)), F.lit(False))).alias("weak"),
            F.forall(w, lambda v: F.coalesce(field(v)("role") == "heading", F.lit(False))).alias("banner"),
            F.forall(w, lambda v: field(v)("source") == "ocr_text").alias("all_ocr"),
            F.get(w, F.lit(0))["text_start"].alias("text_start"), F.element_at(w, -1)["text_end"].alias("text_end"))
    pages = pages.select(*PAGE, F.coalesce("found.median", F.lit(15.0)).alias("median"), F.transform("found.lines", line).alias("lines"))
    return pages.withColumn("lines", F.transform("lines", measured))


def heading_findings(words: ST.Words) -> DataFrame:
    """Headings that begin with a small letter: banners, large lines, one of a pair of parallel
    labels, or a line alone in its block."""
    pages = short_lines(words)
    # Capitalised titles of the page: a small-letter label beside one is half of a pair.
    label = F.filter("lines", lambda l: l["text"].rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$"))
    small = F.filter("lines", lambda l: l["text"].rlike(r"^[a-z][a-z]+(?:\s+[A-Za-z]+){0,4}$") & ~l["weak"])
    cand = pages.select(*PAGE, "median", label.alias("labels"), F.inline(small))
    title = F.col("text").rlike(r"^[a-z]+(?:\s+[A-Z][a-z]+){1,3}$")
    paired = title & F.exists("labels", lambda o: (F.abs(o["y"] - F.col("y")) < 35) & (F.abs(o["x"] - F.col("x")) > 180)
                              & (o["height"] > F.col("height") * 0.55))
    large = (F.col("height") > F.col("median") * 1.65) & (F.col("n_words") <= 4)
    isolated = (title & ~F.col("text").rlike(r"^(?:and|or|the|of|in|to|is|by|a|an|with|for|my|your)" + C.WE)
                & (F.col("block_words") == F.col("n_words")))
    hit = cand.filter(F.col("banner") | large | paired | isolated)
    return hit.select(
        *PAGE, F.lit("lowercase_heading").alias("rule_id"), (F.lit(70000000) + F.col("first")).cast("bigint").alias("seq"),
        F.lit("heading").alias("type"), F.lit("minor").alias("severity"), F.col("text").alias("quote"),
        F.concat(F.upper(F.substring("text", 1, 1)), F.expr("substring(text, 2)")).alias("suggestion"),
        F.lit("A heading starts with a capital letter").alias("explanation"), "xmin", F.col("y").alias("ymin"), "xmax", "ymax",
        F.when(F.col("all_ocr"), "ocr_text").otherwise("pdf_text").alias("box_source"), F.lit("linter").alias("source"),
        "text_start", "text_end", F.lit(0.94).alias("confidence"))


def letter_step_findings(words: ST.Words) -> DataFrame:
    """Wrong arrow labels of an alternating letter exercise.

    The printed rule and the measured letters must agree before a label is called wrong. The
    region below an anchor is at most half a page by 160 units.
    """
    if ST.is_pages(words):
        # Only pages with an anchor become rows.
        pages = words() if callable(words) else words
        words = ST.word_rows(pages.filter(F.exists("words", lambda w: w["str"].rlike("(?i)^Alphabet$"))))
    a = words.filter(F.col("str").rlike("(?i)^Alphabet$")).select(
        *PAGE, F.col("word_idx").alias("anchor"), F.when(F.col("xmin") < 500, 0.0).otherwise(500.0).alias("left"),
        F.col("ymax").alias("a_ymax"))
    w = words.select(*PAGE, "word_idx", "str", "xmin", "ymin", "xmax", "ymax", "source", "confidence", "text_start", "text_end")
    r = (w.join(a, PAGE).filter((F.col("xmin") >= F.col("left")) & (F.col("xmax") <= F.col("left") + 500)
                                & (F.col("ymin") > F.col("a_ymax")) & (F.col("ymax") < F.col("a_ymax") + 160)))
    g = r.groupBy(*PAGE, "anchor").agg(
        F.array_sort(F.collect_list(F.struct(F.floor(F.col("ymin") / 12 + 0.5).alias("row"), "xmin", "word_idx", "str"))).alias("prose"),
        F.array_sort(F.collect_list(F.struct("xmin", "word_idx", "str", "ymin", "xmax", "ymax", "source", "confidence", "text_start", "text_end"))).alias("items"))
    rule = F.regexp_extract(F.array_join(F.transform("prose", lambda x: x["str"]), " "), C.P_LETTER_RULE, 1)
    back = F.regexp_extract(F.array_join(F.transform("prose", lambda x: x["str"]), " "), C.P_LETTER_RULE, 2)
    g = g.select(*PAGE, "anchor", "items", rule.try_cast("int").alias("forward"), (-back.try_cast("int")).alias("backward"))
    g = g.filter("forward IS NOT NULL AND backward IS NOT NULL")
    labels = F.filter("items", lambda x: x["str"].rlike(r"^[+−-]\d+$") & ((x["source"] != "ocr_text") | (x["confidence"] >= 0.85)))
    g = g.withColumn("labels", labels).filter(F.size("labels") == 4)
    ys = F.transform("labels", lambda x: x["ymin"])
    g = g.filter(F.array_max(ys) - F.array_min(ys) <= 10).withColumn("top", F.get("labels", F.lit(0))["ymin"])
    g = g.withColumn("letters", F.filter("items", lambda x: x["str"].rlike(r"^[A-Z?]$") & (x["ymin"] < F.col("top")) & (x["ymin"] > F.col("top") - 55)))
    g = g.withColumn("baseline", F.array_max(F.transform("letters", lambda x: x["ymin"])))
    g = g.withColumn("sequence", F.filter("letters", lambda x: F.abs(x["ymin"] - F.col("baseline")) < 8)).filter(F.size("sequence") == 5)
    codes = F.transform("sequence", lambda x: F.ascii(x["str"]))
    g = g.withColumn("codes", codes).filter(F.forall(F.slice("sequence", 1, 4), lambda x: x["str"].rlike("^[A-Z]$")))
    for i in range(3):
        step = F.col("backward") if i % 2 else F.col("forward")
        g = g.filter(F.get("codes", F.lit(i + 1)) - F.get("codes", F.lit(i)) == step)
    f = g.select(*PAGE, "forward", "backward", F.posexplode("labels").alias("i", "l"))
    expected = F.when(F.col("i") % 2 == 1, F.col("backward")).otherwise(F.col("forward"))
    f = f.withColumn("expected", expected).filter(F.replace(F.col("l.str"), F.lit("−"), F.lit("-")).try_cast("int") != F.col("expected"))
    signed = F.concat(F.when(F.col("expected") > 0, "+").otherwise(""), F.col("expected").cast("string"))
    return f.select(
        *PAGE, F.lit("letter_steps").alias("rule_id"), (F.lit(80000000) + F.col("l.word_idx")).cast("bigint").alias("seq"),
        F.lit("number").alias("type"), F.lit("major").alias("severity"), F.col("l.str").alias("quote"), signed.alias("suggestion"),
        F.concat(F.lit("Step "), (F.col("i") + 1).cast("string"), F.lit(" of the letter pattern must show "), signed).alias("explanation"),
        F.col("l.xmin").alias("xmin"), F.col("l.ymin").alias("ymin"), F.col("l.xmax").alias("xmax"), F.col("l.ymax").alias("ymax"),
        F.col("l.source").alias("box_source"), F.lit("linter").alias("source"), F.col("l.text_start").alias("text_start"),
        F.col("l.text_end").alias("text_end"), F.lit(0.96).alias("confidence"))
