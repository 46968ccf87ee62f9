"""Seed text and geometry laid over the given documents.

The given documents carry no proofing defects, so every page gets a deterministic prefix of
defect lines. The fragments below are plain SQL that means the same in Spark and in the
checking engine; `div` is the only difference between the two dialects.
"""

PAGES_PER_BOOK = 50
ROW_CHARS = 109          # characters per printed row
LINE_PITCH = 18.0        # distance of rows on a page that is not crowded

# (modulus, remainder of doc_id, line put before the text)
DEFECT_LINES = [
    (7, 0, "Note : see the table"),
    (11, 0, "rat: and lion"),
    (13, 0, "Example 1 Example 3 Example 3"),
    (17, 0, "key :: value"),
    (5, 0, "the part will Complete the figure"),
    (15, 0, "the part will Complete the figure"),
    (9, 0, "Page 400"),
    (21, 5, "words Patterns"),
]
LARGE_LINES = ["words Patterns", "Patterns", "Reasoning"]

# Word boxes of a printed letter exercise: text, x, y (height 12, width 8 per character).
EXERCISE = [
    ("Alphabet", 100, 100), ("pattern", 170, 100),
    ("Move", 100, 120), ("4", 140, 120), ("letters", 156, 120), ("forward,", 220, 120),
    ("then", 100, 138), ("1", 140, 138), ("letter", 156, 138), ("backward", 212, 138),
    ("E", 100, 170), ("I", 150, 170), ("H", 200, 170), ("L", 250, 170), ("K", 300, 170),
    ("+4", 125, 200), ("+1", 175, 200), ("+4", 225, 200), ("+1", 275, 200),
    # Two columns, stored row by row.
    ("seek", 100, 60), ("the", 140, 60), ("other", 600, 60), ("words", 648, 60),
    ("hidden", 100, 75), ("marks", 156, 75), ("stand", 600, 75), ("apart", 648, 75),
]
EXERCISE_PAGES = "doc_id % 23 = 4"
#: Findings of a model on those pages: a phrase that runs down one column, one that jumps from column to column, and step labels of which only
#: the letter exercise tells which print is meant.
EXERCISE_FINDINGS = [("down", "grammar", "seek the hidden marks", "seek the hidden mark"), ("across", "grammar", "the other words hidden", "the other word hidden"),
                     ("step", "number", "+1", "-1"), ("wrong", "number", "+1", "+9")]


def exercise_finding_columns(name: str, kind: str, quote: str, suggestion: str) -> list[str]:
    boxes = [f"CAST(NULL AS DOUBLE) AS {b}" for b in ("xmin", "ymin", "xmax", "ymax")]
    return ["book_id", "page_number", "doc_id", f"'{name}' AS rule_id", "CAST(95000000 AS BIGINT) AS seq", f"'{kind}' AS type", "'minor' AS severity", f"'{quote}' AS quote",
            f"'{suggestion}' AS suggestion", "'' AS explanation", *boxes, "'unverified' AS box_source", "'ai' AS source", "CAST(NULL AS INT) AS text_start",
            "CAST(NULL AS INT) AS text_end", "CAST(0.9 AS DOUBLE) AS confidence", "'open' AS status", f"concat('{name}-', CAST(doc_id AS VARCHAR(20))) AS uid"]


def book_no(div: str) -> str:
    return f"(doc_id {div} {PAGES_PER_BOOK})"


def book_id(div: str) -> str:
    return f"concat('book-', lpad(CAST({book_no(div)} AS STRING), 12, '0'))"


PAGE_NUMBER = f"CAST(doc_id % {PAGES_PER_BOOK} + 1 AS INT)"


def head_text(div: str) -> str:
    """Structure lines: contents page, unit and chapter headings, printed openers."""
    p = f"(doc_id % {PAGES_PER_BOOK} + 1)"
    unit_no = f"CAST({p} {div} 16 + 1 AS STRING)"
    chap_no = f"CAST({p} {div} 8 + 1 AS STRING)"
    return (
        f"concat("
        f"CASE WHEN {p} = 1 THEN concat('CONTENTS', chr(10), '1 Patterns 2', chr(10), "
        f"'2 Reasoning 10', chr(10)) ELSE '' END, "
        f"CASE WHEN {p} % 16 = 2 THEN concat('Unit ', {unit_no}, ': ', "
        f"CASE WHEN {p} % 32 = 2 THEN 'Patterns Recognition' ELSE 'Thinking' END, chr(10)) ELSE '' END, "
        f"CASE WHEN {p} % 8 = 2 THEN concat('Chapter ', {chap_no}, ': Topic ', {chap_no}, chr(10)) ELSE '' END, "
        f"CASE WHEN {p} = 3 THEN concat('Patterns', chr(10)) WHEN {p} = 11 THEN concat('Reasoning', chr(10)) "
        f"ELSE '' END)"
    )


def page_text(div: str, text: str = "text") -> str:
    lines = ", ".join(
        f"CASE WHEN doc_id % {m} = {r} THEN concat('{line}', chr(10)) ELSE '' END"
        for m, r, line in DEFECT_LINES)
    return (f"concat({head_text(div)}, {lines}, {text}, "
            f"CASE WHEN doc_id % 19 = 0 THEN concat(chr(10), '77') ELSE '' END)")


def page_status(div: str) -> str:
    b = book_no(div)
    return (f"CASE WHEN {b} % 5 = 0 THEN 'done' "
            f"WHEN {b} % 5 = 1 THEN CASE WHEN doc_id % 10 = 0 THEN 'pending' WHEN doc_id % 10 = 1 THEN 'error' "
            f"ELSE 'done' END "
            f"WHEN {b} % 5 = 2 THEN CASE WHEN doc_id % 4 = 0 THEN 'error' ELSE 'done' END "
            f"WHEN {b} % 5 = 3 THEN CASE WHEN doc_id % 10 < 2 THEN 'pending' WHEN doc_id % 10 = 2 THEN 'processing' "
            f"ELSE 'done' END ELSE 'error' END")


def page_columns(div: str) -> list[tuple[str, str]]:
    return [
        ("book_id", book_id(div)),
        ("page_number", PAGE_NUMBER),
        ("doc_id", "doc_id"),
        ("status", page_status(div)),
        ("tokens_used", "CAST(n_chars % 997 AS BIGINT)"),
        ("evidence_prepared", f"{book_no(div)} % 5 <> 1 OR doc_id % 10 > 2"),
        ("evidence_indexed", "doc_id % 6 <> 0"),
        ("coverage_complete", "doc_id % 12 <> 5"),
        ("subject_key", "CASE doc_id % 4 WHEN 0 THEN 'MATH' WHEN 1 THEN 'SCIENCE' WHEN 2 THEN '' ELSE 'ART' END"),
        ("warning", "CASE WHEN doc_id % 8 = 0 THEN 'OCR contains uncertain words' "
                    "WHEN doc_id % 8 = 3 THEN 'Suppressed first-pass candidates' ELSE '' END"),
    ]


def book_columns() -> list[tuple[str, str]]:
    """Over (book_id, book_no, page_count, lang)."""
    def pick(expr: str, values: list[str]) -> str:
        arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
        return f"CASE {expr} % {len(values)} {arms} END"
    return [
        ("book_id", "book_id"), ("book_no", "CAST(book_no AS BIGINT)"),
        ("title", "concat('Book ', CAST(book_no AS STRING))"),
        ("page_count", "CAST(page_count AS INT)"),
        ("language", "CASE WHEN lang = 'en' THEN 'english' ELSE 'auto' END"),
        ("book_type", pick("book_no", ["textbook", "workbook", "story", "general"])),
        ("status", pick("book_no", ["queued", "processing", "paused", "context_approval", "done", "error"])),
        ("created_s", "CAST(1704067200 + (book_no * 7919) % 86400 AS BIGINT)"),
        ("approved", "book_no % 4 = 1"),
    ]


# Findings as a remote model would return them: every third page carries one.
_QUOTE = "trim(substring(text, 1, 18))"


def model_columns() -> list[tuple[str, str]]:
    """Over pages (needs doc_id, text)."""
    types = ["spelling", "grammar", "punctuation", "page_number", "chapter_alignment", "unit_alignment",
             "heading", "flow", "learning_outcomes", "image", "examples", "wording", "alignment", "layout",
             "typography", "spacing", "overflow", "inconsistency", "number", "other"]
    arm = " ".join(f"WHEN {i * 3} THEN '{t}'" for i, t in enumerate(types))
    nullbox = "doc_id % 5 = 4"
    return [
        ("rule_id", "'model'"), ("seq", "CAST(90000000 AS BIGINT)"),
        ("type", f"CASE doc_id % 60 {arm} END"),
        ("severity", "CASE doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' ELSE 'minor' END"),
        ("quote", _QUOTE), ("suggestion", f"concat({_QUOTE}, ' fixed')"),
        ("explanation", "CASE doc_id % 7 WHEN 0 THEN 'Check the alignment of the figure' "
                        "WHEN 1 THEN 'Remove the space before the colon' WHEN 2 THEN 'The printed page number differs' "
                        "WHEN 3 THEN 'No colon before and' ELSE 'Wrong form' END"),
        ("xmin", f"CASE WHEN {nullbox} THEN NULL ELSE CAST((doc_id * 37) % 900 AS DOUBLE) END"),
        ("ymin", f"CASE WHEN {nullbox} THEN NULL ELSE CAST((doc_id * 53) % 900 AS DOUBLE) END"),
        ("xmax", f"CASE WHEN {nullbox} THEN NULL ELSE CAST((doc_id * 37) % 900 + 80 AS DOUBLE) END"),
        ("ymax", f"CASE WHEN {nullbox} THEN NULL ELSE CAST((doc_id * 53) % 900 + 20 AS DOUBLE) END"),
        ("box_source", "CASE doc_id % 5 WHEN 0 THEN 'ai' WHEN 1 THEN 'pdf_text' WHEN 2 THEN 'ocr_text' "
                       "WHEN 3 THEN 'unverified' ELSE 'ai' END"),
        ("source", "'ai'"), ("text_start", "CAST(NULL AS INT)"), ("text_end", "CAST(NULL AS INT)"),
        ("confidence", "CAST(doc_id % 11 AS DOUBLE) / 10"),
    ]


MODEL_PAGES = "doc_id % 3 = 0"
FINDING_STATUS = ("CASE (doc_id + coalesce(text_start, 2)) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'accepted' "
                  "WHEN 2 THEN 'dismissed' ELSE 'fixed' END")
FINDING_UID = ("concat_ws('|', book_id, CAST(page_number AS STRING), rule_id, "
               "coalesce(CAST(text_start AS STRING), '-'), quote)")


def model_json() -> str:
    """Raw model output of a page: valid, fenced, invalid or truncated (needs doc_id)."""
    issue = ("concat('{\"type\":\"', CASE doc_id % 3 WHEN 0 THEN 'spelling' WHEN 1 THEN 'heading' ELSE 'image' END, "
             "'\",\"severity\":\"', CASE doc_id % 9 WHEN 4 THEN 'huge' ELSE 'major' END, "
             "'\",\"quote\":\"figure ', CAST(doc_id AS STRING), '\",\"suggestion\":\"Figure\",\"explanation\":\"case\",\"box_2d\":[10,20,', "
             "CAST(30 + doc_id % 7 AS STRING), ',', CAST(40 + doc_id % 11 AS STRING), ']}')")
    body = f"concat('{{\"pageKind\":\"content\",\"layoutNotes\":\"\",\"issues\":[', {issue}, ',', {issue}, ']}}')"
    return (f"CASE doc_id % 6 WHEN 0 THEN {body} WHEN 1 THEN concat('```json', chr(10), {body}, chr(10), '```') "
            f"WHEN 2 THEN '{{\"pageKind\":\"content\",\"layoutNotes\":\"\",\"issues\":[]}}' "
            f"WHEN 3 THEN substring({body}, 1, 70) WHEN 4 THEN {body} ELSE 'no findings' END")


def raw_issue_columns() -> list[tuple[str, str]]:
    """One unvalidated model issue per document (needs doc_id)."""
    d = "CAST(doc_id AS STRING)"

    def box(i: int) -> str:
        vals = {0: [10, 20, 5, 8], 1: [-5, 10, 2000, 40], 2: [1, 2, 3, None], 5: [1, None, 3, 4]}
        arms = " ".join(f"WHEN {k} THEN {'NULL' if v[i] is None else f'CAST({v[i]} AS DOUBLE)'}" for k, v in vals.items())
        own = ["doc_id % 900", "doc_id % 700", "doc_id % 900 + 50", "doc_id % 700 + 60"][i]
        return f"CASE doc_id % 6 {arms} WHEN 4 THEN CAST({own} AS DOUBLE) END"
    return [
        ("raw_type", "CASE doc_id % 5 WHEN 0 THEN 'typo' WHEN 2 THEN 'spelling' WHEN 3 THEN 'heading' WHEN 4 THEN 'image' END"),
        ("raw_severity", "CASE doc_id % 3 WHEN 0 THEN 'huge' WHEN 1 THEN 'minor' END"),
        ("quote", f"CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE concat('  figure ', {d}, ' ') END"),
        ("suggestion", f"concat(' Figure ', {d})"),
        ("explanation", "CASE WHEN doc_id % 18 = 0 THEN NULL ELSE ' case ' END"),
        ("raw_confidence", "CASE doc_id % 4 WHEN 0 THEN CAST(1.7 AS DOUBLE) WHEN 1 THEN CAST(-1 AS DOUBLE) WHEN 2 THEN CAST(0.4 AS DOUBLE) END"),
        ("bn", "CASE doc_id % 6 WHEN 2 THEN 3 WHEN 3 THEN NULL ELSE 4 END"),
        *[(f"b{i}", box(i)) for i in range(4)],
    ]


ERROR_MESSAGE = (
    "CASE event_id % 12 WHEN 0 THEN '429 RESOURCE_EXHAUSTED' WHEN 1 THEN 'request timed out' "
    "WHEN 2 THEN '401 UNAUTHENTICATED' WHEN 3 THEN 'ENOENT: no such file' WHEN 4 THEN 'Internal Error in model' "
    "WHEN 5 THEN '{\"error\":{\"message\":\"quota used\"}}' WHEN 6 THEN '{broken' WHEN 7 THEN '403 PERMISSION_DENIED' "
    "WHEN 8 THEN repeat('long message ', 20) WHEN 9 THEN 'JSON_PARSE_ERROR: bad' WHEN 10 THEN '' "
    "ELSE 'stream aborted' END")

# Chat turns: what the user asks for, by conversation and turn.
CHAT_TEXT = (
    "CASE (conv_id + turn) % 8 WHEN 0 THEN concat(text, ' where are issues 1, 2') WHEN 1 THEN 'please pause' "
    "WHEN 2 THEN 'Go to page 3.' WHEN 3 THEN concat('remember that fact ', CAST(conv_id % 5 AS STRING)) "
    "WHEN 4 THEN concat('Remember FACT ', CAST(conv_id % 5 AS STRING)) WHEN 5 THEN 're-analyse page 12' "
    "WHEN 6 THEN concat('issue number 12 , 13, 14 and ', CAST(turn AS STRING)) "
    "ELSE concat(text, ' the part will Complete the figure') END")
INSTRUCTION_TEXT = (
    "concat(text, chr(10), 'Check the figures. Use short words. use short WORDS', chr(10), "
    "'Only flag objective errors.', chr(10), 'Keep version ', CAST(conv_id AS STRING), '!')")

MARK_COLUMNS = [
    ("mark_id", "CASE WHEN doc_id % 97 = 0 THEN 'dup' ELSE concat('m', CAST(doc_id AS STRING)) END"),
    ("mark_type", "CASE WHEN doc_id % 211 = 3 THEN 'star' WHEN doc_id % 3 = 0 THEN 'circle' WHEN doc_id % 3 = 1 THEN 'square' "
                  "ELSE 'highlight' END"),
    ("page", "CASE WHEN doc_id % 173 = 7 THEN 999 ELSE CAST(doc_id % 50 + 1 AS INT) END"),
    ("comment", "concat('look at ', CAST(doc_id AS STRING), CASE quality WHEN 1 THEN ' “good” – fine…' ELSE '' END)"),
    ("mx", "CAST(doc_id % 90 AS DOUBLE)"), ("my", "CAST(doc_id % 80 AS DOUBLE)"),
    ("mw", "CAST(CASE WHEN doc_id % 131 = 11 THEN 0 ELSE 8 END AS DOUBLE)"), ("mh", "CAST(5 AS DOUBLE)"),
]
