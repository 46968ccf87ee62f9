"""Oracle SQL of the rule scans."""
from oracle.base import view, compose
from foliocheck.sources import seeds

P1 = r"(?:^|[\n.!?])[ \t]*([A-Za-z0-9 \t()]{2,45}?)[ \t]+(:-|:—|:)[ \t]*"
P2 = r"(?i)([A-Za-z0-9]+)\s*:\s+(and|or|as well as)\b"
P3 = r"(?i)\b(?:Page|Pg\.?)\s*(\d+)\b"
P4 = r"(?i)\b(Solved Example|Example|Illustration|Activity)\s*(\d+)\b"
P5 = r"([A-Za-z0-9]+)\s*(::|\s+-\s+:)\s*"
P6 = r"\b(will|shall|would|could|should|must|may|might|can)\s+(Complete)\b"
ALL = [("heading_colon", P1), ("conjunction_colon", P2), ("page_label", P3), ("example", P4),
       ("malformed_colon", P5), ("modal_capital", P6)]


def hits(rule, pat):
    return f"""SELECT book_id, page_number, doc_id, '{rule}' AS rule_id, unnest(range(len(h))) AS i,
      unnest(h) AS hit, unnest(p[1:len(h)]) AS gap, unnest(p[2:len(h)+1]) AS nxt
      FROM (SELECT book_id, page_number, doc_id, regexp_extract_all(text, '{pat}', 0) AS h,
                   regexp_split_to_array(text, '{pat}') AS p FROM pages_v WHERE regexp_matches(text, '{pat}'))"""


view("hits_raw", "\nUNION ALL ".join(hits(r, p) for r, p in ALL))
view("hits_v", """SELECT * EXCLUDE (gap), CAST(sum(length(gap) + length(hit)) OVER
  (PARTITION BY book_id, page_number, rule_id ORDER BY i) - length(hit) AS INT) AS pos FROM hits_raw""")


def shape(order, type_, sev, conf, expl, rule=None):
    r = f"'{rule}'" if rule else "rule_id"
    return (f"SELECT book_id, page_number, doc_id, {r} AS rule_id, CAST({order} * 10000000 + text_start AS BIGINT) AS seq, "
            f"'{type_}' AS type, {sev} AS severity, quote, suggestion, {expl} AS explanation, 0.0::DOUBLE AS xmin, 0.0::DOUBLE AS ymin, "
            f"1000.0::DOUBLE AS xmax, 1000.0::DOUBLE AS ymax, 'unverified' AS box_source, 'linter' AS source, "
            f"CAST(text_start AS INT) AS text_start, CAST(text_start + length(quote) AS INT) AS text_end, "
            f"CAST({conf} AS DOUBLE) AS confidence ")


view("d1_v", shape(1, "punctuation", "'major'", 0.98, "'Remove the space before the colon: write ' || suggestion") + r"""
 FROM (SELECT *, regexp_replace(quote, '[ \t]+(:-|:—|:)$', '\1') || ' ' AS suggestion,
        regexp_replace(quote, '[ \t]+(:-|:—|:)$', '') AS head
   FROM (SELECT *, rtrim(cut, chr(32) || chr(9)) AS quote, pos + length(hit) - length(cut) AS text_start
     FROM (SELECT *, regexp_replace(hit, '^[\n.!?]?[ \t]*', '') AS cut FROM hits_v WHERE rule_id = 'heading_colon')))
 WHERE NOT (regexp_matches(head, '^[0-9]+$') AND regexp_matches(nxt, '^[0-9]'))
   AND head <> '' AND NOT regexp_matches(lower(head), '^(http|https|e\.g|i\.e)$')""")
view("d2_v", shape(2, "punctuation", "'major'", 0.96, "'No colon before a conjunction: write ' || suggestion") + rf"""
 FROM (SELECT *, hit AS quote, pos AS text_start, regexp_replace(hit, '{P2}', '\1 \2') AS suggestion
       FROM hits_v WHERE rule_id = 'conjunction_colon')""")
view("d5_v", shape(5, "punctuation", "'minor'", 0.95, "'Malformed colon: write ' || suggestion") + rf"""
 FROM (SELECT *, rtrim(hit, chr(32) || chr(10)) AS quote, pos AS text_start, regexp_extract(hit, '{P5}', 1) || ':' AS suggestion
       FROM hits_v WHERE rule_id = 'malformed_colon')""")
view("d6_v", shape(6, "typography", "'minor'", 0.98, "'A verb after a modal verb starts with a small letter'") + r"""
 FROM (SELECT *, hit AS quote, pos AS text_start, regexp_replace(hit, 'Complete$', 'complete') AS suggestion
       FROM hits_v WHERE rule_id = 'modal_capital')""")
view("d4_v", shape(4, "examples", "CASE WHEN num = prev THEN 'major' ELSE 'minor' END",
                   "CASE WHEN num = prev THEN 0.92 ELSE 0.88 END",
                   "CASE WHEN num = prev THEN 'Duplicate number: repeats ' ELSE 'Number skipped after ' END || prev_quote",
                   "example_number") + rf"""
 FROM (SELECT *, hit AS quote, pos AS text_start, regexp_replace(hit, '[0-9]+$', '') || CAST(prev + 1 AS VARCHAR) AS suggestion
   FROM (SELECT *, lag(num) OVER w AS prev, lag(hit) OVER w AS prev_quote
     FROM (SELECT *, lower(regexp_extract(hit, '{P4}', 1)) AS label, CAST(regexp_extract(hit, '{P4}', 2) AS BIGINT) AS num
           FROM hits_v WHERE rule_id = 'example')
     WINDOW w AS (PARTITION BY book_id, page_number, label ORDER BY pos))
   WHERE num = prev OR num > prev + 1)""")
view("page_counts_v", "SELECT book_id, CAST(count(*) AS INT) AS page_count FROM pages_v GROUP BY book_id")
view("d3_v", shape(3, "page_number", "'major'", 0.85,
                   "'Printed page number ' || CAST(num AS VARCHAR) || ' differs from the expected ' || CAST(page_number AS VARCHAR)",
                   "page_number") + r"""
 FROM (SELECT *, hit AS quote, pos AS text_start, 'Page ' || CAST(page_number AS VARCHAR) AS suggestion,
        row_number() OVER (PARTITION BY book_id, page_number ORDER BY tail, pos) AS rn
   FROM (SELECT *, CAST(regexp_extract(hit, '([0-9]+)$', 1) AS BIGINT) AS num FROM (
     SELECT book_id, page_number, doc_id, hit, pos, 0 AS tail FROM hits_v WHERE rule_id = 'page_label'
     UNION ALL
     SELECT book_id, page_number, doc_id, tok, length(text) - length(tok), 1 FROM (
       SELECT *, regexp_extract(text, '(?:^|\s)([0-9]{1,4})$', 1) AS tok FROM pages_v JOIN page_counts_v USING (book_id))
     WHERE tok <> '' AND CAST(tok AS INT) > 0 AND CAST(tok AS INT) <= page_count + 50))
   WHERE abs(num - page_number) > 15)
 WHERE rn = 1""")
view("lint_text_v", "SELECT * FROM d1_v UNION ALL SELECT * FROM d2_v UNION ALL SELECT * FROM d4_v "
                    "UNION ALL SELECT * FROM d5_v UNION ALL SELECT * FROM d6_v")
_mc = ", ".join(f"{s} AS {n}" for n, s in seeds.model_columns())
view("model_findings_v", f"""SELECT book_id, page_number, doc_id, rule_id, seq, type, severity, quote, suggestion, explanation,
  xmin, ymin, xmax, ymax, box_source, source, text_start, text_end, confidence FROM
  (SELECT book_id, page_number, doc_id, {_mc} FROM pages_v WHERE {seeds.MODEL_PAGES})""")
view("findings_v", f"""SELECT *, {seeds.FINDING_STATUS} AS status, sha256({seeds.FINDING_UID}) AS uid
  FROM (SELECT * FROM lint_text_v UNION ALL SELECT * FROM model_findings_v)""")

OUT = "book_id, page_number, seq, rule_id, type, severity, quote, suggestion, text_start, text_end, confidence"
ORACLES = {
    "d1_heading_colon": compose(f"SELECT {OUT} FROM d1_v"),
    "d2_conjunction_colon": compose(f"SELECT {OUT} FROM d2_v"),
    "d3_page_number_sequence": compose(f"SELECT {OUT}, explanation FROM d3_v"),
    "d4_example_numbering": compose(f"SELECT {OUT}, explanation FROM d4_v"),
    "d5_malformed_colon": compose(f"SELECT {OUT} FROM d5_v"),
    "d6_modal_capital": compose(f"SELECT {OUT} FROM d6_v"),
}
