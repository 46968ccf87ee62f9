"""Shared SQL views for the DuckDB side, and the composer that prefixes a query with them."""
from __future__ import annotations

import re

from foliocheck.sources import seeds

VIEWS: dict[str, str] = {}
WB, WE = r"\b", r"\b"


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def compose(body: str) -> str:
    """Prefix `body` with every view it names, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def need(sql: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", sql):
                seen.add(name)          # before its own SQL, which may name it: a recursive view
                need(VIEWS[name])
                order.append(name)
    need(body)
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n.endswith(('_rw', '_p', '_m3', '_gr', '_mat')) else ''}({VIEWS[n]})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {ctes},\n{body[5:]}"
    return f"WITH RECURSIVE {ctes}\n{body}"


def _cols(columns):
    return ", ".join(f"{sql} AS {name}" for name, sql in columns)


view("pages_v", f"SELECT {_cols(seeds.page_columns('//'))}, {seeds.page_text('//')} AS text FROM documents")
view("books_v", f"""
SELECT {_cols(seeds.book_columns())} FROM (
  SELECT {seeds.book_no('//')} AS book_no, {seeds.book_id('//').replace('doc_id', 'min(doc_id)')} AS book_id,
         count(*) AS page_count, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1)""")
view("lines_v", """
SELECT book_id, page_number, doc_id, n_chars, n_lines, line_no, line,
       CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS BIGINT) AS line_start
FROM (SELECT book_id, page_number, doc_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines,
             unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS line_no FROM pages_v)""")
_large = ", ".join(f"'{v}'" for v in seeds.LARGE_LINES)
view("text_words_v", f"""
SELECT book_id, page_number, doc_id, str, x AS xmin, y0 + pitch * row AS ymin,
       least(1000.0::DOUBLE, x + 7.5::DOUBLE * length(str)) AS xmax, y0 + pitch * row + h AS ymax,
       CAST(line_start + off AS INT) AS text_start, CAST(line_start + off + length(str) AS INT) AS text_end
FROM (SELECT *, least(12.0::DOUBLE, pitch * 2 / 3) * CASE WHEN large THEN 2 ELSE 1 END AS h,
        CASE WHEN NOT toc_row THEN 60.0::DOUBLE + 7.5::DOUBLE * (off % {seeds.ROW_CHARS})
             WHEN w_no = 0 THEN 60.0::DOUBLE WHEN w_no = line_words - 1 THEN 760.0::DOUBLE
             ELSE 120.0::DOUBLE + 7.5::DOUBLE * off END AS x
  FROM (SELECT *, least({seeds.LINE_PITCH}::DOUBLE, (940.0::DOUBLE - y0) / n_rows) AS pitch
    FROM (SELECT *, CASE WHEN {seeds.EXERCISE_PAGES} THEN 300.0::DOUBLE ELSE 40.0::DOUBLE END AS y0,
             line_no + line_start // {seeds.ROW_CHARS} + off // {seeds.ROW_CHARS} AS row,
             n_lines + n_chars // {seeds.ROW_CHARS} + 1 AS n_rows,
             page_number = 1 AND line_no IN (1, 2) AS toc_row,
             line IN ({_large}) OR line LIKE 'Chapter %' AS large
      FROM (SELECT *, CAST(sum(length(str) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY w_no)
                           - length(str) - 1 AS BIGINT) AS off
        FROM (SELECT *, len(string_split(line, ' ')) AS line_words, unnest(string_split(line, ' ')) AS str,
                     unnest(range(len(string_split(line, ' ')))) AS w_no FROM lines_v)) WHERE str <> '')))""")


def _exercise() -> str:
    rows, off = [], 1
    for text, x, y in seeds.EXERCISE:
        rows.append(f"('{text}', {x}::DOUBLE, {y}::DOUBLE, {off})")
        off += len(text) + 1
    return ", ".join(rows)


view("words_v", f"""
SELECT book_id, page_number, doc_id, text_start AS word_idx, str, xmin, ymin, xmax, ymax, text_start, text_end FROM text_words_v
UNION ALL
SELECT book_id, page_number, doc_id, CAST(length(text) + off AS INT), s, x, y, x + 8 * length(s), y + 12,
       CAST(length(text) + off AS INT), CAST(length(text) + off + length(s) AS INT)
FROM pages_v, (VALUES {_exercise()}) AS e(s, x, y, off) WHERE {seeds.EXERCISE_PAGES}""")
view("ocr_words_v", """
SELECT * FROM (SELECT *, CAST((doc_id * 31 + text_start) % 100 AS DOUBLE) / 100 AS confidence,
  CAST(CAST(floor(ymin / 100) AS INT) AS VARCHAR) AS block_id, CAST(CAST(floor(ymin) AS BIGINT) AS VARCHAR) AS line_id FROM words_v)
WHERE confidence >= 0.35""")
view("responses_v", f"""
SELECT {seeds.book_id('//')} AS book_id, {seeds.PAGE_NUMBER} AS page_number, doc_id, {seeds.model_json()} AS raw,
  CASE doc_id % 10 WHEN 7 THEN 'MAX_TOKENS' WHEN 8 THEN NULL WHEN 9 THEN 'FINISH_REASON_UNSPECIFIED'
  ELSE 'STOP' END AS finish_reason FROM documents""")
