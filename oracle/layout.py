"""Oracle SQL of page evidence and layout rules."""
from oracle.base import view, compose
from oracle.intake import squash

view("tsv_v", r"""SELECT book_id, page_number, text_start AS line_no, str, text_start % 41 <> 40 AS is_word, text_start % 53 <> 52 AS finite,
  CAST(floor(xmin * 2) AS BIGINT) AS l, CAST(floor(ymin) AS BIGINT) AS t, CAST(floor((xmax - xmin) * 2) AS BIGINT) AS w,
  (doc_id * 31 + text_start) % 100 AS conf, CAST(CAST(floor(ymin / 100) AS INT) AS VARCHAR) AS block_id FROM words_v""")
view("tsv2_v", """SELECT *, conf < 35 AS uncertain, greatest(0, least(1000, l / 2000.0 * 1000)) AS x0, greatest(0, least(1000, t / 1000.0 * 1000)) AS y0
  FROM tsv_v WHERE is_word AND finite AND w > 0""")
view("tsv3_v", """SELECT *, greatest(x0, least(1000, (l + w) / 2000.0 * 1000)) AS x1, greatest(y0, least(1000, (t + 12) / 1000.0 * 1000)) AS y1 FROM tsv2_v""")


def case4(vals):
    return "CAST(CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(vals)) + " END AS DOUBLE)"


view("runs_v", f"""SELECT book_id, page_number, CAST(line_no AS INT) AS run_idx, line AS str, {case4([10, 0, -10, 0])} AS a, {case4([0, 10, 0, -10])} AS b,
  {case4([0, -10, 0, 10])} AS c, {case4([10, 0, -10, 0])} AS d, CAST(250 + doc_id % 100 AS DOUBLE) AS e, CAST(400 + (line_no * 12) % 300 AS DOUBLE) AS f,
  5.0::DOUBLE * length(line) AS width FROM lines_v""")
view("run_words_v", r"""SELECT *, length(word) * 10 - 5 * (length(word) - length(regexp_replace(word, '[iljtf r1.,:;]', '', 'g')))
  + 4 * (length(word) - length(regexp_replace(word, '[WMwm]', '', 'g'))) AS adv FROM (
  SELECT *, unnest(string_split(str, ' ')) AS word, CAST(unnest(range(len(string_split(str, ' ')))) AS INT) AS w_no FROM runs_v WHERE trim(str) <> '')""")
view("run_words2_v", """SELECT *, CAST(sum(length(word) + 1) OVER (PARTITION BY book_id, page_number ORDER BY run_idx, w_no) - 1 AS INT) AS te,
  CAST(sum(adv + 5) OVER (PARTITION BY book_id, page_number, run_idx ORDER BY w_no) - 5 AS BIGINT) AS adv_end,
  CAST(sum(adv + 5) OVER (PARTITION BY book_id, page_number, run_idx) - 5 AS BIGINT) AS total FROM run_words_v""")
view("run_words3_v", """SELECT *, e + a / 10 * p AS qx0, e + a / 10 * q AS qx1, f + b / 10 * p AS qy0, f + b / 10 * q AS qy1 FROM (
  SELECT *, (adv_end - adv) / total * width AS p, adv_end / total * width AS q FROM run_words2_v)""")
view("run_words4_v", """SELECT *, greatest(0, least(1000, least(qx0 - .2 * c, qx0 + .8 * c, qx1 - .2 * c, qx1 + .8 * c) / 600 * 1000)) AS x0,
  greatest(qx0 - .2 * c, qx0 + .8 * c, qx1 - .2 * c, qx1 + .8 * c) / 600 * 1000 AS rx1,
  greatest(0, least(1000, (800 - greatest(qy0 - .2 * d, qy0 + .8 * d, qy1 - .2 * d, qy1 + .8 * d)) / 800 * 1000)) AS y0,
  (800 - least(qy0 - .2 * d, qy0 + .8 * d, qy1 - .2 * d, qy1 + .8 * d)) / 800 * 1000 AS ry1 FROM run_words3_v""")
LINE = "CAST(CAST(floor(ymin / 10 + 0.5) AS BIGINT) AS VARCHAR) || CASE WHEN xmin < 500 THEN ':left' ELSE ':right' END"
view("plines_v", f"""SELECT l.*, m.median, p.page_words FROM (SELECT book_id, page_number, line, min(word_idx) AS first, string_agg(str, ' ' ORDER BY xmin, word_idx) AS text,
   min(ymin) AS y, min(ymax - ymin) AS height, min(xmin) AS x, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS n_words,
   arg_min(text_start, (xmin, word_idx)) AS text_start, arg_max(text_end, (xmin, word_idx)) AS text_end
  FROM (SELECT *, {LINE} AS line FROM words_v) GROUP BY ALL) l
 JOIN (SELECT book_id, page_number, list_sort(list(ymax - ymin))[CAST(count(*) // 2 AS INT) + 1] AS median FROM words_v WHERE ymax > ymin GROUP BY ALL) m
   ON m.book_id = l.book_id AND m.page_number = l.page_number
 JOIN (SELECT book_id, page_number, count(*) AS page_words FROM words_v GROUP BY ALL) p ON p.book_id = l.book_id AND p.page_number = l.page_number""")
view("cand_v", r"SELECT *, regexp_matches(text, '^[a-z]+(?:\s+[A-Z][a-z]+){1,3}$') AS title FROM plines_v WHERE regexp_matches(text, '^[a-z][a-z]+(?:\s+[A-Za-z]+){0,4}$')")
view("d7_v", r"""SELECT book_id, page_number, CAST(70000000 + first AS BIGINT) AS seq, 'heading' AS type, 'minor' AS severity, text AS quote, upper(text[1]) || text[2:] AS suggestion,
  round(x, 6) AS xmin, round(y, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax, 'pdf_text' AS box_source, text_start, text_end, 0.94::DOUBLE AS confidence
  FROM cand_v c WHERE (height > median * 1.65 AND n_words <= 4)
   OR (title AND EXISTS (SELECT 1 FROM plines_v o WHERE o.book_id = c.book_id AND o.page_number = c.page_number AND abs(o.y - c.y) < 35 AND abs(o.x - c.x) > 180
        AND o.height > c.height * .55 AND regexp_matches(o.text, '^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$')))
   OR (title AND NOT regexp_matches(text, '^(?:and|or|the|of|in|to|is|by|a|an|with|for|my|your)\b') AND page_words = n_words)""")
view("region_v", """SELECT w.*, a.word_idx AS anchor FROM words_v w JOIN (SELECT *, CASE WHEN xmin < 500 THEN 0 ELSE 500 END AS lft FROM words_v WHERE lower(str) = 'alphabet') a
  ON a.book_id = w.book_id AND a.page_number = w.page_number AND w.xmin >= lft AND w.xmax <= lft + 500 AND w.ymin > a.ymax AND w.ymax < a.ymax + 160""")
view("rule_v", r"""SELECT *, CAST(regexp_extract(prose, '(?i)Move\s+(\d+)\s+letters?\s+forward,?\s+then\s+(\d+)\s+letters?\s+backward', 1) AS INT) AS fw,
  -CAST(regexp_extract(prose, '(?i)Move\s+(\d+)\s+letters?\s+forward,?\s+then\s+(\d+)\s+letters?\s+backward', 2) AS INT) AS bw FROM
  (SELECT book_id, page_number, anchor, string_agg(str, ' ' ORDER BY floor(ymin / 12 + .5), xmin) AS prose FROM region_v GROUP BY ALL)
  WHERE regexp_matches(prose, '(?i)Move\s+(\d+)\s+letters?\s+forward,?\s+then\s+(\d+)\s+letters?\s+backward')""")
view("labels_v", r"""SELECT *, count(*) OVER w AS n, max(ymin) OVER w - min(ymin) OVER w AS spread, row_number() OVER (w ORDER BY xmin) - 1 AS i, first_value(ymin) OVER (w ORDER BY xmin) AS top
  FROM region_v WHERE regexp_matches(str, '^[+−-]\d+$') WINDOW w AS (PARTITION BY book_id, page_number, anchor)""")
view("seq_v", """SELECT book_id, page_number, anchor, list(str ORDER BY xmin) AS s FROM (SELECT r.*, max(r.ymin) OVER (PARTITION BY r.book_id, r.page_number, r.anchor) AS baseline
  FROM region_v r JOIN (SELECT DISTINCT book_id, page_number, anchor, top FROM labels_v WHERE n = 4 AND spread <= 10) l
   ON l.book_id = r.book_id AND l.page_number = r.page_number AND l.anchor = r.anchor AND r.ymin < top AND r.ymin > top - 55 WHERE regexp_matches(r.str, '^[A-Z?]$'))
  WHERE abs(ymin - baseline) < 8 GROUP BY ALL""")
view("d8_v", r"""SELECT l.book_id, l.page_number, CAST(80000000 + word_idx AS BIGINT) AS seq, 'number' AS type, 'major' AS severity, str AS quote,
  CASE WHEN ex > 0 THEN '+' ELSE '' END || ex AS suggestion, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax,
  'pdf_text' AS box_source, text_start, text_end, 0.96::DOUBLE AS confidence FROM (
  SELECT l.*, CASE WHEN i % 2 = 1 THEN bw ELSE fw END AS ex, fw, bw, s FROM labels_v l JOIN rule_v r ON r.book_id = l.book_id AND r.page_number = l.page_number AND r.anchor = l.anchor
   JOIN seq_v q ON q.book_id = l.book_id AND q.page_number = l.page_number AND q.anchor = l.anchor
  WHERE n = 4 AND spread <= 10 AND len(s) = 5) l WHERE s[1] <> '?' AND s[2] <> '?' AND s[3] <> '?' AND s[4] <> '?'
  AND ascii(s[2]) - ascii(s[1]) = fw AND ascii(s[3]) - ascii(s[2]) = bw AND ascii(s[4]) - ascii(s[3]) = fw
  AND CAST(replace(replace(str, '−', '-'), '+', '') AS INT) <> ex""")


def letters(c):
    return rf"length(regexp_replace({c}, '[^\p{{L}}]', '', 'g'))"


def covers(a, b):
    ov = f"greatest(0, least({a}.xmax, {b}.xmax) - greatest({a}.xmin, {b}.xmin)) * greatest(0, least({a}.ymax, {b}.ymax) - greatest({a}.ymin, {b}.ymin))"
    ar = "({0}.xmax - {0}.xmin) * ({0}.ymax - {0}.ymin)"
    return f"{a}.book_id = {b}.book_id AND {a}.page_number = {b}.page_number AND {ov} / greatest(1, least({ar.format(a)}, {ar.format(b)})) > .65"


view("base_v", "SELECT * FROM ocr_words_v WHERE text_start % 2 = 0")
view("extra_v", "SELECT * REPLACE (xmin + text_start % 4 * 4 AS xmin, xmax + text_start % 4 * 12 AS xmax) FROM ocr_words_v WHERE text_start % 3 = 0")
view("extra1_v", f"SELECT * FROM extra_v e WHERE NOT EXISTS (SELECT 1 FROM base_v b WHERE {covers('e', 'b')})")
# Words with an earlier overlapping word, and the recursion that decides them in order.
view("conf_v", f"""SELECT e.book_id, e.page_number, e.word_idx, row_number() OVER (PARTITION BY e.book_id, e.page_number ORDER BY e.word_idx) AS n, list(o.word_idx) AS before
  FROM extra1_v e JOIN extra1_v o ON {covers('e', 'o')} AND o.word_idx < e.word_idx GROUP BY e.book_id, e.page_number, e.word_idx""")
view("drops_v", """WITH RECURSIVE r AS (SELECT DISTINCT book_id, page_number, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS dropped FROM conf_v
  UNION ALL SELECT c.book_id, c.page_number, c.n, CASE WHEN len(list_filter(c.before, lambda x: NOT list_contains(r.dropped, x))) > 0
   THEN list_append(r.dropped, c.word_idx) ELSE r.dropped END FROM r JOIN conf_v c ON c.book_id = r.book_id AND c.page_number = r.page_number AND c.n = r.n + 1)
  SELECT book_id, page_number, unnest(arg_max(dropped, n)) AS word_idx FROM r GROUP BY book_id, page_number""")
view("merged_v", """SELECT e.*, b.base_len, sum(length(str) + 1) OVER (PARTITION BY e.book_id, e.page_number ORDER BY e.word_idx) AS run FROM extra1_v e
  LEFT JOIN drops_v d ON d.book_id = e.book_id AND d.page_number = e.page_number AND d.word_idx = e.word_idx
  LEFT JOIN (SELECT book_id, page_number, sum(length(str) + 1) AS base_len FROM base_v GROUP BY ALL) b ON b.book_id = e.book_id AND b.page_number = e.page_number
  WHERE d.word_idx IS NULL""")

ORACLES = {
    "a9_read_ocr_tsv": compose("""SELECT book_id, page_number, line_no, str, uncertain, CASE WHEN x1 > x0 AND y1 > y0 THEN round(CAST(x0 AS DOUBLE), 6) END AS xmin,
      CASE WHEN x1 > x0 AND y1 > y0 THEN round(CAST(y0 AS DOUBLE), 6) END AS ymin, CASE WHEN x1 > x0 AND y1 > y0 THEN round(CAST(x1 AS DOUBLE), 6) END AS xmax,
      CASE WHEN x1 > x0 AND y1 > y0 THEN round(CAST(y1 AS DOUBLE), 6) END AS ymax, CASE WHEN NOT uncertain THEN CAST(en - length(str) AS INT) END AS text_start,
      CASE WHEN NOT uncertain THEN CAST(en AS INT) END AS text_end, round(conf / 100, 6) AS confidence, block_id, '1' AS paragraph_id, CAST(t AS VARCHAR) AS line_id
      FROM (SELECT *, sum(CASE WHEN uncertain THEN 0 ELSE length(str) + 1 END) OVER (PARTITION BY book_id, page_number ORDER BY line_no) - 1 AS en
        FROM tsv3_v WHERE uncertain OR (x1 > x0 AND y1 > y0))"""),
    "a10_runs_to_words": compose("""SELECT book_id, page_number, run_idx, w_no, word AS str, round(x0, 6) AS xmin, round(y0, 6) AS ymin, round(x1, 6) AS xmax, round(y1, 6) AS ymax,
      CAST(te - length(word) AS INT) AS text_start, te AS text_end, 'pdf_text' AS source FROM (SELECT *, greatest(x0, least(1000, rx1)) AS x1, greatest(y0, least(1000, ry1)) AS y1 FROM run_words4_v)
      WHERE x1 > x0 AND y1 > y0 AND width <> 0"""),
    "a11_page_text": compose(f"""SELECT book_id, page_number, sha256(t) AS digest, CAST(length(t) AS BIGINT) AS chars FROM
      (SELECT book_id, page_number, {squash("string_agg(str, ' ' ORDER BY run_idx)")} AS t FROM runs_v GROUP BY ALL)"""),
    "c3_choose_evidence": compose(f"""SELECT n.book_id, n.page_number, words, coalesce(ow, 0) AS ocr_words,
      CASE WHEN NOT (letters >= 120 AND words >= 25) AND ow > 0 THEN 'ocr_text' ELSE 'pdf_text' END AS source,
      CASE WHEN NOT (letters >= 120 AND words >= 25) AND ow IS NULL THEN 'No confident words were recovered; locations remain unverified.' ELSE '' END AS warning
      FROM (SELECT book_id, page_number, count(*) AS words, sum({letters('str')}) AS letters FROM words_v GROUP BY ALL) n
      LEFT JOIN (SELECT book_id, page_number, count(*) AS ow FROM ocr_words_v GROUP BY ALL) o ON o.book_id = n.book_id AND o.page_number = n.page_number"""),
    "f7_layout_transcript": compose("""SELECT book_id, page_number, sha256(t) AS digest, CAST(length(t) AS BIGINT) AS chars FROM (SELECT book_id, page_number, string_agg(l, chr(10) ORDER BY first) AS t FROM
      (SELECT book_id, page_number, block_id, line_id, string_agg(str, ' ' ORDER BY xmin, word_idx) AS l, min(word_idx) AS first FROM ocr_words_v GROUP BY ALL) GROUP BY ALL)"""),
    "f8_page_lines": compose("SELECT book_id, page_number, text, round(y, 6) AS y, round(height, 6) AS height, round(x, 6) AS x, n_words, round(median, 6) AS median FROM plines_v"),
    "w4_text_offsets": compose("""SELECT book_id, page_number, word_idx, CAST(en - length(str) AS INT) AS text_start, CAST(en AS INT) AS text_end FROM
      (SELECT *, sum(length(str) + 1) OVER (PARTITION BY book_id, page_number ORDER BY word_idx) - 1 AS en FROM ocr_words_v)"""),
    "j13_merge_ocr_passes": compose("""SELECT book_id, page_number, word_idx, str, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax,
      CAST(coalesce(base_len, 1) + run - 1 - length(str) AS INT) AS text_start, CAST(coalesce(base_len, 1) + run - 1 AS INT) AS text_end, 'sparse:' || block_id AS block_id FROM merged_v"""),
    "j14_words_in_bands": compose("""SELECT w.book_id, w.page_number, word_idx, str, 'heading' AS role FROM ocr_words_v w JOIN pages_v p ON p.book_id = w.book_id AND p.page_number = w.page_number
      WHERE confidence >= .8 AND xmin >= 48 AND xmax <= 502 + p.doc_id % 300 AND ymin >= 38 + p.doc_id % 40 AND ymax <= 162 + p.doc_id % 40"""),
    "d7_lowercase_heading": compose("SELECT * FROM d7_v"),
    "d8_letter_steps": compose("SELECT * FROM d8_v"),
}
