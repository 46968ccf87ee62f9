"""Column functions over text. All of them stay inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliocheck import constants as C


_MAY_FOLD = r"[^\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E]"


def nfkc(col: Column) -> Column:
    """Compatibility folding (NFKC) by the Unicode library that ships with Spark.

    ASCII and the accented Latin letters (without ligatures and the long s) never change, so
    only other text is folded, and no row leaves the JVM.
    """
    folded = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))
    return F.when(col.rlike(_MAY_FOLD), folded).otherwise(col)


def strip(col: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(col, F.lit(" \t\r\n\f\v"))


def squash(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def squash_head(col: Column, n: int) -> Column:
    """The first `n` characters of `squash`; the whole text is gone through only where its beginning is mostly blanks."""
    head = squash(F.substring(col, 1, 4 * n))
    return F.when((F.length(col) <= 4 * n) | (F.length(head) > n), F.substring(head, 1, n)).otherwise(F.substring(squash(col), 1, n))


def clip(col: Column, n: int) -> Column:
    """At most `n` characters: 68 % of the room from the front, the rest from the end."""
    text, head = squash(col), max(1, int(n * 0.68))
    tail = max(1, n - head - 5)
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.substring(text, 1, head), F.lit(" ... "), F.substring(text, -tail, tail)))


def slug(col: Column) -> Column:
    dashed = F.regexp_replace(F.lower(squash(col)), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 70)


def location_tokens(col: Column, case_sensitive: bool = False, fold: bool = True) -> Column:
    """Letter and digit runs of a text, digits split from letters."""
    text = F.coalesce(col, F.lit(""))
    if fold:
        text = nfkc(text)
    text = F.regexp_replace(text, r"(\p{L})(\p{N})", "$1 $2")
    text = F.regexp_replace(text, r"(\p{N})(\p{L})", "$1 $2")
    if not case_sensitive:
        text = F.lower(text)
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens_of_words(words: Column, joined: Column) -> Column:
    """The location tokens of each word of a list; `joined` are the words with line ends between them.

    Letters are folded and split from digits once for all words; only a word that holds a line end itself, or is null, needs each for itself.
    """
    parts = F.split(joined, "\n")
    return F.when(F.size(parts) == F.size(words), F.transform(parts, lambda p: F.when(F.trim(p) == "", F.array().cast("array<string>")).otherwise(
        F.split(F.trim(p), " ")))).otherwise(F.transform(words, lambda w: location_tokens(w, case_sensitive=True)))


def folded_words(words: Column) -> Column:
    """Words joined by line ends, folded as for location tokens, with one blank for all else between letters and digits."""
    text = nfkc(F.array_join(words, "\n"))
    text = F.regexp_replace(text, r"(\p{L})(\p{N})", "$1 $2")
    text = F.regexp_replace(text, r"(\p{N})(\p{L})", "$1 $2")
    return F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")


def literal_text(col: Column) -> Column:
    return squash(col)


def requires_literal_match(quote: Column, suggestion: Column, fold: bool = True) -> Column:
    """Only letter case or punctuation changes, so the printed characters themselves matter."""
    same_words = F.array_join(location_tokens(quote, fold=fold), " ") == \
        F.array_join(location_tokens(suggestion, fold=fold), " ")
    has = F.coalesce(suggestion, F.lit("")) != ""
    return has & (literal_text(quote) != literal_text(suggestion)) & same_words


def clean_text(col: Column, fold: bool = True) -> Column:
    """Text as compared between findings: folded, one minus sign, single blanks."""
    text = F.coalesce(col, F.lit(""))
    if fold:
        text = nfkc(text)
    return squash(F.replace(text, F.lit("−"), F.lit("-")))


def minimal_edit(quote: Column, suggestion: Column) -> Column:
    """struct(before, after, start): the changed part once common ends are stripped.

    `quote` and `suggestion` must already be `clean_text`. Null when equal or empty.
    """
    q, s = quote, suggestion
    short = F.least(F.length(q), F.length(s))

    def first_difference(limit: Column, left, right) -> Column:
        hits = F.filter(F.sequence(F.lit(1), limit), lambda k: left(k) != right(k))
        return F.when(limit < 1, F.lit(0)).otherwise(F.coalesce(F.get(hits, F.lit(0)) - 1, limit))

    start = first_difference(short, lambda k: F.substring(q, k, F.lit(1)), lambda k: F.substring(s, k, F.lit(1)))
    rest = short - start
    end = first_difference(rest, lambda k: F.substring(q, F.length(q) - k + 1, F.lit(1)),
                           lambda k: F.substring(s, F.length(s) - k + 1, F.lit(1)))
    edit = F.struct(F.substring(q, start + 1, F.length(q) - start - end).alias("before"),
                    F.substring(s, start + 1, F.length(s) - start - end).alias("after"),
                    start.cast("int").alias("start"))
    return F.when((q != "") & (s != "") & (q != s), edit)


def is_contents_page(text: Column, variant: str = "heading") -> Column:
    """`heading` looks at the first 1000 characters, `printed` at the whole page and Hindi too."""
    if variant == "heading":
        return F.substring(text, 1, 1000).rlike(C.P_CONTENTS)
    return text.rlike(C.P_CONTENTS_PRINTED)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def has_native_evidence(letter_count: Column, word_count: Column) -> Column:
    return (letter_count >= C.NATIVE_MIN_LETTERS) & (word_count >= C.NATIVE_MIN_WORDS)


def is_indexed(flag: Column, text: Column) -> Column:
    return flag | (F.length(text) >= C.INDEXED_MIN_CHARS)


def search_terms(col: Column) -> Column:
    """Distinct words of three or more characters, stop words out, the first twelve."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))
    stop = F.array(*[F.lit(w) for w in C.STOP_WORDS])
    return F.slice(F.array_except(words, stop), 1, 12)


def issue_refs(query: Column) -> Column:
    """Distinct numbers of "issues 12, 13 and 14", at most thirty. A number beyond any issue number is none."""
    listed = F.regexp_extract(
        query, r"(?i)" + C.WB + r"issues?\s*(?:numbers?|nos?\.?|#)?\s*((?:\d+\s*(?:(?:,|and|&|-)\s*)?)+)", 1)
    numbers = F.transform(F.regexp_extract_all(listed, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint"))
    return F.slice(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())), 1, 30)


def ascii_fold(col: Column) -> Column:
    """Text for a standard page font: plain quotes and dashes, nothing outside ASCII."""
    t = F.translate(F.coalesce(col, F.lit("")), "“”‘’—–", "\"\"''--")
    return F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), r"[^\x00-\x7F]", "")
