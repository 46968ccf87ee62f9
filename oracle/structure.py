"""Oracle SQL of book structure and chapter contexts."""
from oracle.base import view, compose
from oracle.intake import squash
from oracle.layout import LINE
from foliocheck.sources import seeds

H = r"(?i)^(Unit|Chapter|Ch\.?)[ \t-]*(\d+)\s*[:.\-–—]\s*([^.!?]{2,80})$"
TOCL = r"^\s*(\d+)\s*[.:\-]?\s+(.{3,70}?)\s+(\d{1,3})\s*$"
view("contents_v", r"SELECT book_id, page_number FROM pages_v WHERE regexp_matches(substring(text, 1, 1000), '(?i)\b(?:contents|table of contents|index)\b')")
view("hl_v", rf"""SELECT *, CASE WHEN k = 'unit' THEN concat('Unit ', number, ': ', name) ELSE '' END AS unit FROM (
  SELECT l.book_id, l.page_number, CAST(line_no AS INT) AS line_no, lower(regexp_extract(s, '{H}', 1)) AS k, CAST(regexp_extract(s, '{H}', 2) AS BIGINT) AS number, trim(regexp_extract(s, '{H}', 3)) AS name
  FROM (SELECT *, regexp_replace(line, '^[|¦\s]+', '') AS s FROM lines_v) l ANTI JOIN contents_v c ON c.book_id = l.book_id AND c.page_number = l.page_number WHERE regexp_matches(s, '{H}'))""")


def observed(src):
    return f"""SELECT book_id, page_number AS page, line_no, number, name, unit, CAST(CASE WHEN unit <> '' THEN .55 ELSE .8 END AS DOUBLE) AS confidence,
      CASE WHEN unit <> '' THEN 'unit_heading' ELSE 'body_heading' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_number, name ORDER BY line_no) AS f FROM
      (SELECT *, row_number() OVER (PARTITION BY book_id, unit <> '', number ORDER BY page_number, line_no) AS n FROM {src}) WHERE unit = '' OR n = 1) WHERE f = 1"""


view("obs_v", observed("hl_v"))
view("hlw_v", """SELECT h.* FROM hl_v h SEMI JOIN (SELECT DISTINCT book_id, page_number FROM words_v WHERE ymin < 330 AND regexp_matches(str, '(?i)^(?:unit|chapter|ch)')) w
  ON w.book_id = h.book_id AND w.page_number = h.page_number""")
view("obsw_v", observed("hlw_v"))


def bounds(cand):
    """Chapters tiling each book from candidate starts (with an order column ord)."""
    return rf"""SELECT c.*, CAST(coalesce(lead(page) OVER (PARTITION BY c.book_id ORDER BY page) - 1, b.page_count) AS INT) AS end_page, page AS start_page,
      concat('chapter-', page, '-', substring(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', '-', 'g'), 1, 70)) AS chapter_key FROM (
      SELECT book_id, page, number, name, unit, confidence, source FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY confidence DESC, ord) AS rn FROM {cand}) WHERE rn = 1
      UNION ALL SELECT b.book_id, 1, 0, CASE WHEN f IS NULL THEN 'Unclassified content' ELSE 'Front matter' END, '', 0.2::DOUBLE, CASE WHEN f IS NULL THEN 'book_fallback' ELSE 'front_matter' END
       FROM books_v b LEFT JOIN (SELECT book_id, min(page) AS f FROM {cand} GROUP BY book_id) m ON m.book_id = b.book_id WHERE f IS NULL OR f > 1) c JOIN books_v b ON b.book_id = c.book_id"""


view("cand_text_v", "SELECT *, CAST(page AS BIGINT) * 100000 + line_no AS ord FROM obs_v")
view("chapters_v", bounds("cand_text_v"))
view("ptoc_v", rf"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY book_id, title, printed_page ORDER BY page_number, line_no) AS rn FROM (
  SELECT l.book_id, l.page_number, line_no, CAST(regexp_extract(line, '{TOCL}', 1) AS BIGINT) AS number, trim(regexp_extract(line, '{TOCL}', 2)) AS title, CAST(regexp_extract(line, '{TOCL}', 3) AS INT) AS printed_page
  FROM lines_v l SEMI JOIN contents_v c ON c.book_id = l.book_id AND c.page_number = l.page_number WHERE regexp_matches(line, '{TOCL}'))) WHERE rn = 1""")
view("cw_v", "SELECT w.*, (ymin + ymax) / 2 AS mid FROM words_v w SEMI JOIN contents_v c ON c.book_id = w.book_id AND c.page_number = w.page_number")
view("pair_v", r"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY book_id, lower(title), printed_page ORDER BY page_number, label) AS rn FROM (
  SELECT r.book_id, r.page_number, r.label, coalesce(CAST(regexp_replace(n.s, '\D', '', 'g') AS BIGINT), 0) AS number, r.title, r.printed_page FROM
   (SELECT l.book_id, l.page_number, l.word_idx AS label, l.mid, CAST(l.str AS INT) AS printed_page, trim(regexp_replace(string_agg(b.str, ' ' ORDER BY b.xmin, b.word_idx), '^\d+[.:]?\s+', '')) AS title
    FROM cw_v l JOIN cw_v b ON b.book_id = l.book_id AND b.page_number = l.page_number AND b.xmin >= 100 AND b.xmax < l.xmin - 30 AND abs(b.mid - l.mid) < greatest(8, (l.ymax - l.ymin) * .6)
    WHERE l.xmin > 700 AND regexp_matches(l.str, '^\d{1,3}$') GROUP BY ALL) r
   LEFT JOIN (SELECT l.book_id, l.page_number, l.word_idx AS label, arg_min(n.str, n.word_idx) AS s FROM cw_v l JOIN cw_v n ON n.book_id = l.book_id AND n.page_number = l.page_number AND n.xmin < 100
     AND regexp_matches(n.str, '^\d+[.:]?$') AND abs(n.mid - l.mid) < 10 WHERE l.xmin > 700 GROUP BY ALL) n ON n.book_id = r.book_id AND n.page_number = r.page_number AND n.label = r.label
  WHERE length(title) >= 3 AND NOT regexp_matches(title, '(?i)^(?:Unit|Chapter|Ch[.])\b'))) WHERE rn = 1""")
view("toc_all_v", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY book_id, lower(title), printed_page ORDER BY page_number, ord) AS rn FROM (
  SELECT book_id, page_number, CAST(label AS BIGINT) AS ord, number, title, printed_page FROM pair_v UNION ALL SELECT book_id, page_number, line_no + 1000000000, number, title, printed_page FROM ptoc_v)) WHERE rn = 1""")


def openers(units):
    return f"""SELECT o.book_id, o.page, o.number, o.name, coalesce(u.unit, '') AS unit, 0.95::DOUBLE AS confidence, 'toc_opener' AS source FROM (
      SELECT * FROM (SELECT l.book_id, l.page_number AS page, t.number, l.name, row_number() OVER (PARTITION BY l.book_id, lower(l.name) ORDER BY l.page_number, l.first) AS rn FROM
       (SELECT *, trim(regexp_replace(text, '^[|¦\\s]+', '')) AS name FROM plines_v WHERE y <= 330 AND height >= median * 1.4) l
       ANTI JOIN contents_v c ON c.book_id = l.book_id AND c.page_number = l.page_number
       JOIN (SELECT book_id, lower(title) AS key, arg_min(number, (page_number, ord)) AS number FROM toc_all_v GROUP BY ALL) t ON t.book_id = l.book_id AND t.key = lower(l.name)) WHERE rn = 1) o
      LEFT JOIN (SELECT o.book_id, o.page_number AS page, arg_max(h.unit, (h.page, h.line_no)) AS unit FROM pages_v o JOIN {units} h ON h.book_id = o.book_id AND h.unit <> '' AND h.page <= o.page_number GROUP BY ALL) u
       ON u.book_id = o.book_id AND u.page = o.page"""


view("open_v", openers("obs_v"))
view("openw_v", openers("obsw_v"))
view("cand_full_v", """SELECT book_id, page, number, name, unit, confidence, source, CAST(page AS BIGINT) * 100000 + line_no AS ord FROM obsw_v
  UNION ALL SELECT book_id, page, number, name, unit, confidence, source, CAST(page AS BIGINT) * 100000 + 100000000000 FROM openw_v
  UNION ALL SELECT book_id, page, coalesce(TRY_CAST(number AS BIGINT), 0), name, unit, 1.0::DOUBLE, 'bookmark', place - 100000000000 FROM flat_v WHERE name IS NOT NULL""")
view("chapters_full_v", bounds("cand_full_v"))
view("outline_v", f"""WITH b AS (SELECT {seeds.book_id('//')} AS book_id, doc_id % 50 + 1 AS p FROM documents)
  SELECT book_id, p * 10 + 1 AS node_id, CAST(NULL AS BIGINT) AS parent_id, p AS ord, CASE WHEN p % 32 = 2 THEN concat('Unit ', p // 16 + 1, ': Thinking') ELSE concat('Part ', p // 16 + 1) END AS title, CAST(NULL AS BIGINT) AS page FROM b WHERE p % 16 = 2
  UNION ALL SELECT book_id, p * 10 + 2, ((p - 2) // 16 * 16 + 2) * 10 + 1, p, concat('Chapter ', p // 8 + 1, ': Topic ', p // 8 + 1), CASE WHEN p % 24 = 2 THEN 999 ELSE p END FROM b WHERE p % 8 = 2
  UNION ALL SELECT book_id, 900, NULL, 99, 'Appendix', 50 FROM b WHERE p = 50""")
view("sib_v", "SELECT *, last_value(CASE WHEN regexp_matches(title, '(?i)^Unit\\b') THEN title END IGNORE NULLS) OVER (PARTITION BY book_id, parent_id ORDER BY ord, node_id) AS own FROM outline_v")
view("tree_v", """WITH RECURSIVE t AS (SELECT book_id, node_id, title, page, coalesce(own, '') AS unit, lpad(CAST(ord AS VARCHAR), 9, '0') || '.' || lpad(CAST(node_id AS VARCHAR), 9, '0') AS path FROM sib_v WHERE parent_id IS NULL
  UNION ALL SELECT s.book_id, s.node_id, s.title, s.page, coalesce(s.own, t.unit), t.path || '/' || lpad(CAST(s.ord AS VARCHAR), 9, '0') || '.' || lpad(CAST(s.node_id AS VARCHAR), 9, '0') FROM sib_v s JOIN t ON t.book_id = s.book_id AND t.node_id = s.parent_id) SELECT * FROM t""")
view("flat_v", r"""SELECT f.book_id, CAST(node_id AS INT) AS node_id, title, pg AS page, unit, row_number() OVER (PARTITION BY f.book_id ORDER BY path) - 1 AS place,
  CASE WHEN pg IS NOT NULL AND regexp_matches(title, '(?i)^Chapter\s*(\d+)') THEN regexp_extract(title, '(?i)^Chapter\s*(\d+)\s*[:.-]?\s*(.*)$', 1) END AS number,
  CASE WHEN pg IS NOT NULL AND regexp_matches(title, '(?i)^Chapter\s*(\d+)') THEN regexp_extract(title, '(?i)^Chapter\s*(\d+)\s*[:.-]?\s*(.*)$', 2) END AS name
  FROM (SELECT t.*, CAST(CASE WHEN t.page BETWEEN 1 AND b.page_count THEN t.page END AS INT) AS pg FROM tree_v t JOIN books_v b ON b.book_id = t.book_id) f""")
view("toc_rows_v", """SELECT book_id, title, page, CAST(NULL AS INT) AS printed_page, 'pdf' AS page_numbering, place AS ord FROM flat_v
  UNION ALL SELECT book_id, title, page, NULL, 'pdf', place + 500 FROM flat_v UNION ALL SELECT book_id, title, NULL, printed_page, 'printed', line_no + 1000 FROM ptoc_v""")
view("toc_once_v", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY book_id, title, page_numbering, coalesce(page, printed_page) ORDER BY ord) AS rn FROM toc_rows_v) WHERE rn = 1""")
view("placed_v", "SELECT p.*, c.chapter_key, c.start_page, c.end_page, c.name AS chapter_name, c.confidence AS conf FROM pages_v p JOIN chapters_v c ON c.book_id = p.book_id AND p.page_number BETWEEN c.start_page AND c.end_page")
view("source_v", f"""SELECT book_id, chapter_key, sha256('chapter-context-v2' || chr(10) || chapter_key || chr(10) || s) AS content_hash, CAST(length(s) AS BIGINT) AS source_chars, start_page FROM
  (SELECT book_id, chapter_key, start_page, string_agg('[[PAGE ' || page_number || ']]' || chr(10) || {squash('text')}, chr(10) || chr(10) ORDER BY page_number) AS s FROM placed_v GROUP BY ALL)""")
NO = "CAST(substring(book_id, 6, 20) AS BIGINT)"
view("contexts_v", f"""SELECT book_id, chapter_key, CASE WHEN ({NO} + start_page) % 3 = 0 THEN 'old' ELSE content_hash END AS content_hash, 'chapter-context-v2' AS analysis_version,
  CASE WHEN {NO} % 4 = 3 AND start_page = 10 THEN 'error' WHEN {NO} % 2 = 0 OR start_page < 20 THEN 'ready' ELSE 'pending' END AS status, CAST(start_page * 10 AS BIGINT) AS tokens_used FROM source_v WHERE start_page <> 42
  UNION ALL SELECT book_id, 'chapter-7-gone', 'x', 'chapter-context-v1', 'ready', 5 FROM books_v""")
view("items_v", """SELECT book_id, chapter_key, page_number % 2 AS part, doc_id * 10 + n AS ord, ['topics','rules','characters','activities','guidance','concerns'][doc_id % 2 * 3 + n % 3 + 1] AS field,
  concat(CASE WHEN n % 2 = 0 THEN 'Item ' ELSE 'ITEM ' END, (doc_id + n) % 9) AS key, doc_id FROM (SELECT *, unnest(range(7)) AS n FROM placed_v)""")
view("know_v", """SELECT concat('book-', lpad(CAST(conv_id // 7 AS VARCHAR), 12, '0')) AS book_id, conv_id * 100 + turn AS seq, text, CASE turn % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'page' ELSE 'chapter' END AS scope,
  conv_id % 50 + 1 AS page_number FROM conversations""")
INDEXED = "(evidence_indexed OR length(text) >= 180)"
view("excerpt_v", f"""SELECT p.book_id, p.page_number, p.chapter_key, p.start_page, p.end_page, p.chapter_name, p.conf, count(q.page_number) AS indexed,
  string_agg('[PDF page ' || q.page_number || '] ' || substring(q.text, 1, CAST(greatest(100, floor(6600 / greatest(1, q.idx))) AS INT)), chr(10) ORDER BY abs(q.page_number - p.page_number), q.page_number) AS body
  FROM placed_v p LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY book_id, chapter_key) AS idx FROM placed_v WHERE {INDEXED}) q ON q.book_id = p.book_id AND q.chapter_key = p.chapter_key GROUP BY ALL""")
view("split1_v", f"""SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY page_number) - 1 AS place FROM (SELECT book_id, chapter_key, page_number, {squash('text')} AS t FROM placed_v) WINDOW w AS (PARTITION BY book_id, chapter_key)""")
view("split2_v", """SELECT *, place // greatest(1, CAST(ceil(n / least(2, greatest(1, ceil(est / 18000)))) AS BIGINT)) AS chunk FROM (SELECT *, sum(least(length(t), share)) OVER (PARTITION BY book_id, chapter_key) AS est FROM
  (SELECT *, floor((32000 - n * 24) / n) AS share FROM split1_v))""")
view("split3_v", """SELECT *, CAST(greatest(160, least(share, floor((18000 - size * 24) / size))) AS BIGINT) AS budget FROM (SELECT *, count(*) OVER (PARTITION BY book_id, chapter_key, chunk) AS size FROM split2_v)""")
CARD = """concat('CHAPTER SUMMARY (version chapter-context-v2; pages ', start_page, '-', end_page, '; certainty of its limits ', printf('%.2f', conf), ')', chr(10), 'Chapter: ', chapter_name, '. Kind: lesson. Main subject: topic of ', chapter_name, '.', chr(10),
  'Summary: An overview.', chr(10), 'Covers: Shapes | Page ', page_number, chr(10), 'Leaves out: nothing', chr(10),
  CASE WHEN page_number % 2 = 0 THEN concat('For this page:', chr(10), '- Page ', page_number, ': expected text; continuity next') ELSE 'For this page: nothing noted' END, chr(10),
  CASE WHEN page_number % 3 = 0 OR page_number < 4 THEN concat('Doubts raised by the chapter:', chr(10), '- Page ? order hypothesis (0.50): late Evidence: line 2') WHEN page_number % 4 = 0 THEN
   concat('Doubts raised by the chapter:', chr(10), '- Page ', page_number, ' order hypothesis (0.50): late Evidence: line 2') ELSE 'Doubts raised by the chapter: no doubts here' END, chr(10),
  'Ideas and rules: Order', chr(10), 'Aims: Read | Write', chr(10), 'Terms: None', chr(10), 'Who and what:', chr(10), '- Ann: guide; tall; relations: Bob; pages ', page_number, ', 3', chr(10),
  'Order of events: None', chr(10), 'Activities:', chr(10), '- Draw (pages ', page_number, '): practice; alignment: good')"""
SLUG = rf"substring(regexp_replace(regexp_replace(lower({squash('name')}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70)"
BH = r"(?i)(?:^|\s)(?:chapter|ch\.?|अध्याय)\s*(\d+)\s*[:.\-–—]?\s*([^.!?।]{2,90})"

view("body_v", rf"""SELECT book_id, CAST(regexp_extract(hit, '{BH}', 1) AS BIGINT) AS number, substring(regexp_replace({squash(f"regexp_extract(hit, '{BH}', 2)")}, '\s{{2,}}.*', ''), 1, 90) AS name, page_number AS page, '' AS unit,
      0.92::DOUBLE AS confidence, 'body_heading' AS source, 'pdf' AS page_numbering FROM (SELECT *, regexp_extract(top, '{BH}', 0) AS hit FROM (SELECT *, substring({squash('text')}, 1, 500) AS top FROM pages_v))
      WHERE NOT regexp_matches(top, '(?i)\b(?:table\s+of\s+contents|contents|index|विषय[ -]?सूची)\b') AND hit <> '' AND instr(top, hit) - 1 <= 180""")
view("numbered_v", f"""SELECT book_id, page, number, name, unit, confidence, source, ord FROM (SELECT s.*, row_number() OVER (PARTITION BY s.book_id, CASE WHEN number <> 0 THEN CAST(number AS VARCHAR)
    ELSE {SLUG} || '-' || page END ORDER BY confidence DESC, ord) AS rn FROM (
      SELECT book_id, page, coalesce(TRY_CAST(number AS BIGINT), 0) AS number, name, unit, 0.82::DOUBLE AS confidence, 'bookmark' AS source, place AS ord FROM flat_v WHERE name IS NOT NULL
      UNION ALL SELECT book_id, page, number, name, unit, confidence, source, page + 1000000 FROM body_v) s JOIN books_v b ON b.book_id = s.book_id WHERE page BETWEEN 1 AND page_count) WHERE rn = 1""")

ORACLES = {
    "r1_body_headings": compose("SELECT * FROM body_v"),
    "r2_observed_headings": compose("SELECT * FROM obsw_v"),
    "r3_printed_toc": compose("SELECT book_id, number, title, printed_page FROM ptoc_v"),
    "r4_flatten_outline": compose("SELECT * EXCLUDE (place) FROM flat_v"),
    "r5_infer_chapters": compose("SELECT book_id, start_page, end_page, number, name, unit, confidence, source, chapter_key FROM chapters_full_v"),
    "r6_refresh_contexts": compose("""SELECT coalesce(s.book_id, c.book_id) AS book_id, coalesce(s.chapter_key, c.chapter_key) AS chapter_key, coalesce(s.content_hash, c.content_hash) AS content_hash,
      CASE WHEN s.book_id IS NULL THEN 'removed' WHEN c.book_id IS NULL THEN 'new' WHEN s.content_hash = c.content_hash AND analysis_version = 'chapter-context-v2' THEN 'kept' ELSE 'reset' END AS action,
      CASE WHEN s.book_id IS NULL OR (s.content_hash = c.content_hash AND analysis_version = 'chapter-context-v2') THEN status ELSE 'pending' END AS status
      FROM source_v s FULL JOIN contexts_v c ON c.book_id = s.book_id AND c.chapter_key = s.chapter_key"""),
    "j1_assign_chapters": compose("SELECT book_id, page_number, chapter_key FROM placed_v"),
    "j2_expected_chapter": compose("""WITH o AS (SELECT p.book_id, p.page_number, arg_max(f.title, (f.page, f.place)) AS t, arg_max(f.unit, (f.page, f.place)) AS u FROM pages_v p LEFT JOIN flat_v f ON f.book_id = p.book_id AND f.name IS NOT NULL AND f.page <= p.page_number GROUP BY ALL),
      s AS (SELECT book_id, string_agg(title || CASE WHEN page_numbering = 'pdf' THEN ' (PDF pg ' || coalesce(CAST(page AS VARCHAR), '?') || ')' ELSE ' (printed pg ' || coalesce(CAST(printed_page AS VARCHAR), '?') || '; PDF position unverified)' END, '; ' ORDER BY ord) AS toc_summary
        FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord) AS rn FROM toc_once_v) WHERE rn <= 10 GROUP BY book_id)
      SELECT o.book_id, o.page_number, coalesce(t, '') AS expected_chapter, coalesce(u, '') AS expected_unit, toc_summary FROM o LEFT JOIN s ON s.book_id = o.book_id"""),
    "j3_pair_toc_columns": compose("SELECT book_id, page_number, number, title, printed_page FROM pair_v"),
    "j4_toc_openers": compose("SELECT * FROM open_v"),
    "w1_chapter_bounds": compose("SELECT book_id, start_page, end_page, name, source, chapter_key FROM chapters_v"),
    "w1_numbered_bounds": compose(f"""SELECT book_id, page AS start_page, CAST(CASE WHEN lead(page) OVER w IS NULL THEN page_count ELSE greatest(page, lead(page) OVER w - 1) END AS INT) AS end_page, number, name, unit, confidence, source,
      concat('chapter-', CASE WHEN number <> 0 THEN number ELSE row_number() OVER w END, '-', CASE WHEN {SLUG} <> '' THEN {SLUG} ELSE CAST(page AS VARCHAR) END) AS chapter_key
      FROM (SELECT n.*, page_count FROM (SELECT * FROM numbered_v UNION ALL SELECT book_id, 1, 1, 'Unclassified book content', '', 0.2::DOUBLE, 'book_fallback', 0 FROM books_v ANTI JOIN numbered_v USING (book_id)) n
        JOIN books_v b ON b.book_id = n.book_id) WINDOW w AS (PARTITION BY book_id ORDER BY page, ord)"""),
    "w2_best_start_per_number": compose("SELECT book_id, page, number, name, unit, confidence, source FROM numbered_v"),
    "w2_best_start_per_page": compose("SELECT book_id, page, number, name, unit, confidence, source FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY confidence DESC, ord) AS rn FROM cand_text_v) WHERE rn = 1"),
    "w3_running_unit": compose("""SELECT p.book_id, p.page_number, coalesce(arg_max(h.unit, (h.page, h.line_no)), '') AS unit FROM pages_v p LEFT JOIN obs_v h ON h.book_id = p.book_id AND h.unit <> '' AND h.page <= p.page_number GROUP BY ALL"""),
    "c9_sparse_chapter": compose(f"SELECT book_id, chapter_key, round(a, 6) AS avg_chars, a < 180 AS sparse FROM (SELECT book_id, chapter_key, avg(length({squash('text')})) AS a FROM placed_v GROUP BY ALL)"),
    "f6_token_usage": compose("SELECT book_id, chapter_key, page_number, CAST(sum(tokens_used) AS BIGINT) AS tokens, count(*) AS pages FROM placed_v GROUP BY ROLLUP (book_id, chapter_key, page_number) HAVING book_id IS NOT NULL"),
    "f6_chapter_status": compose("""SELECT book_id, count(*) AS chapters, CAST(sum(tokens_used) AS BIGINT) AS tokens, CASE WHEN bool_or(status = 'error') THEN 'degraded' WHEN bool_and(status = 'ready') THEN 'ready' ELSE 'building' END AS status
      FROM contexts_v GROUP BY book_id"""),
    "f10_merge_memories": compose("""WITH l AS (SELECT *, lower(key) AS k, CASE WHEN field = 'concerns' THEN 5 ELSE 8 END AS lim FROM items_v),
      a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_key, field, part, k ORDER BY ord) AS rn FROM l) WHERE rn = 1),
      b AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY book_id, chapter_key, field, part ORDER BY ord) AS p FROM a) WHERE p <= lim),
      c AS (SELECT * FROM (SELECT * EXCLUDE (p), row_number() OVER (PARTITION BY book_id, chapter_key, field, k ORDER BY part, ord) AS rn FROM b) WHERE rn = 1)
      SELECT book_id, chapter_key, field, CAST(place AS INT) AS place, concat(key, ' on ', doc_id) AS value FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_key, field ORDER BY part, ord) AS place FROM c) WHERE place <= lim"""),
    "f10_fold_memories": compose("""WITH p AS (SELECT book_id, chapter_key, page_number AS part, doc_id, page_number AS n FROM placed_v),
      i AS (SELECT book_id, chapter_key, part, 0 AS ord, 'topic' AS field, lower('Topic ' || doc_id % 5) AS k, 'Topic ' || doc_id % 5 AS value, 3 AS lim FROM p
       UNION ALL SELECT book_id, chapter_key, part, 0, 'overview', lower('View ' || doc_id % 7), 'View ' || doc_id % 7, 3 FROM p
       UNION ALL SELECT book_id, chapter_key, part, j, 'topics', 'item ' || (doc_id + j) % 9, ['Item ', 'ITEM '][j + 1] || (doc_id + j) % 9, 8 FROM p, range(2) r(j)
       UNION ALL SELECT book_id, chapter_key, part, 0, 'rules', 'rule', 'Rule', 8 FROM p
       UNION ALL SELECT book_id, chapter_key, part, 0, 'concepts', 'c' || doc_id % 30, 'C' || doc_id % 30, 8 FROM p
       UNION ALL SELECT book_id, chapter_key, part, 0, 'terms', CAST(doc_id % 3 AS VARCHAR), substring(repeat('longer ', 20), 1, 68) || ' ... ' || right(repeat('longer ', 20) || doc_id % 3, 27), 8 FROM p
       UNION ALL SELECT book_id, chapter_key, part, 0, 'continuity', 'c' || doc_id % 11, 'c' || doc_id % 11, 8 FROM p
       UNION ALL SELECT book_id, chapter_key, part, 0, 'characters', 'ann ' || doc_id % 6, 'Ann ' || doc_id % 6 || '|role ' || doc_id || '|tall||' || CASE WHEN n = 3 THEN '3' ELSE n || ',3' END, 8 FROM p
       UNION ALL SELECT book_id, chapter_key, part, 0, 'activities', CAST(n // 3 AS VARCHAR), 'Draw|p' || doc_id || '|good|' || n // 3, 8 FROM p
       UNION ALL SELECT book_id, chapter_key, part, 0, 'guidance', CAST(n // 2 AS VARCHAR), n // 2 || '|e' || doc_id || '|next', 8 FROM p
       UNION ALL SELECT book_id, chapter_key, part, 0, 'concerns', n % 3 || ':' || doc_id % 4, n % 3 || '|Order|late ' || doc_id % 4 || '|v' || doc_id || '|0.5', 5 FROM p),
      a AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY book_id, chapter_key, field, k ORDER BY part, ord) = 1),
      b AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_key, field ORDER BY part, ord) AS place FROM a QUALIFY place <= lim)
      SELECT book_id, chapter_key, field, CAST(place AS INT) AS place, value FROM b WHERE field NOT IN ('topic', 'overview')
      UNION ALL SELECT book_id, chapter_key, 'topic', 1, string_agg(value, ' / ' ORDER BY place) FROM b WHERE field = 'topic' GROUP BY book_id, chapter_key
      UNION ALL SELECT book_id, chapter_key, 'overview', 1, string_agg(value, ' | ' ORDER BY place) FROM b WHERE field = 'overview' GROUP BY book_id, chapter_key
      UNION ALL SELECT book_id, chapter_key, 'kind', 1, coalesce(arg_min('kind' || doc_id % 4, part) FILTER (WHERE doc_id % 3 <> 0), 'general') FROM p GROUP BY ALL"""),
    "f11_chapter_source": compose("SELECT book_id, chapter_key, content_hash, source_chars FROM source_v"),
    "f12_evidence_hash": compose("""SELECT book_id, sha256(string_agg(sha256(page_number || chr(9) || CAST(evidence_indexed AS VARCHAR) || chr(9) || text), chr(10) ORDER BY page_number)) AS evidence_hash FROM pages_v GROUP BY book_id"""),
    "f13_structure_status": compose(f"""SELECT b.book_id, b.page_count, i AS indexed, CASE WHEN i < page_count THEN 'partial' WHEN w THEN 'degraded' ELSE 'ready' END AS status FROM books_v b
      JOIN (SELECT book_id, count(*) FILTER (WHERE {INDEXED}) AS i FROM pages_v GROUP BY book_id) p ON p.book_id = b.book_id
      JOIN (SELECT book_id, bool_or(confidence < .6 AND source <> 'front_matter') AS w FROM chapters_v GROUP BY book_id) c ON c.book_id = b.book_id"""),
    "f14_chapter_coverage": compose(f"""SELECT book_id, chapter_key, indexed, total, CASE WHEN indexed < total THEN 'Of this chapter, ' || indexed || '/' || total || ' pages are indexed, so checks across it see only a part.'
       WHEN confidence < .6 THEN 'Where this chapter begins or ends is a guess; a person should confirm what depends on it.' WHEN status = 'error' THEN 'There is no summary of this chapter; its page texts can still be used.' ELSE '' END AS warning,
       CASE WHEN status = 'ready' THEN analysis_version || ':' || substring(content_hash, 1, 12) ELSE 'evidence:' || indexed || '/' || total END AS context_version FROM (
      SELECT c.book_id, c.chapter_key, c.confidence, CAST(c.end_page - c.start_page + 1 AS BIGINT) AS total, coalesce(i.n, 0) AS indexed, x.status, x.content_hash, x.analysis_version FROM chapters_v c
       LEFT JOIN (SELECT book_id, chapter_key, count(*) FILTER (WHERE {INDEXED}) AS n FROM placed_v GROUP BY ALL) i ON i.book_id = c.book_id AND i.chapter_key = c.chapter_key
       LEFT JOIN contexts_v x ON x.book_id = c.book_id AND x.chapter_key = c.chapter_key)"""),
    "f16_dedupe_toc": compose("SELECT book_id, title, page, printed_page, page_numbering FROM toc_once_v"),
    "f16_u2_merge_units": compose("SELECT DISTINCT book_id, unit FROM (SELECT book_id, unit FROM obs_v UNION ALL SELECT book_id, unit FROM flat_v) WHERE unit <> ''"),
    "j19_scoped_knowledge": compose("""SELECT book_id, page_number, substring(string_agg('- ' || substring(text, 1, 240), chr(10) ORDER BY seq), 1, 1800) AS knowledge FROM (
      SELECT p.book_id, p.page_number, k.seq, k.text, row_number() OVER (PARTITION BY p.book_id, p.page_number ORDER BY k.seq DESC) AS r FROM pages_v p JOIN know_v k ON k.book_id = p.book_id
       AND (scope = 'book' OR (scope = 'page' AND k.page_number = p.page_number))) WHERE r <= 12 GROUP BY ALL"""),
    "j22_remember_facts": compose(r"""SELECT book_id, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY book_id, lower(text) ORDER BY ord) AS rn FROM (
      SELECT concat('book-', lpad(CAST(conv_id // 7 AS VARCHAR), 12, '0')) AS book_id, conv_id * 100 + turn AS ord, substring(trim(regexp_extract(message, '(?is)^\s*(?:/remember|remember(?:\s+that)?)\s+(.+)$', 1)), 1, 500) AS text FROM chat_v) WHERE text <> '') f
      WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM books_v b WHERE b.book_id = f.book_id AND lower(concat('FACT ', b.book_no % 5)) = lower(f.text))"""),
    "j21_stale_contexts": compose("""SELECT x.book_id, x.chapter_key, x.status FROM contexts_v x ANTI JOIN chapters_v c ON c.book_id = x.book_id AND c.chapter_key = x.chapter_key"""),
    "u4_purge_books": compose("""WITH live AS (SELECT book_id FROM books_v WHERE book_no % 7 <> 6 AND book_no % 5 <> 2)
      SELECT book_id, CAST(page_number AS VARCHAR) AS key, 'page' AS kind FROM pages_v SEMI JOIN live USING (book_id)
      UNION ALL SELECT book_id, chapter_key, 'context' FROM contexts_v SEMI JOIN live USING (book_id)"""),
    "w11_local_context": compose("""SELECT book_id, chapter_key, page_number, sha256(c) AS context, CAST(length(c) AS BIGINT) AS chars FROM (SELECT *, concat('Chapter: ', chapter_name, '; PDF pages ', start_page, '-', end_page, '; certainty of its limits ', conf,
       '.', chr(10), 'Pages read so far: ', indexed, '/', end_page - start_page + 1, ' chapter pages. ', CASE WHEN indexed < end_page - start_page + 1 THEN 'PARTIAL CONTEXT: the rest of the chapter has not been read.'
        ELSE 'The whole chapter has been read; long pages are cut below.' END, chr(10), substring(coalesce(body, ''), 1, 6600)) AS c FROM excerpt_v)"""),
    "w12_split_chapter": compose("""SELECT book_id, chapter_key, page_number, CAST(chunk AS BIGINT) AS chunk, budget, sha256(c) AS text, CAST(length(c) AS BIGINT) AS chars FROM (SELECT *, CASE WHEN length(t) <= budget THEN t ELSE
       substring(t, 1, CAST(greatest(1, floor(budget * .68)) AS INT)) || ' ... ' || right(t, CAST(greatest(1, budget - greatest(1, floor(budget * .68)) - 5) AS INT)) END AS c FROM split3_v)"""),
    "w13_render_context": compose(f"""SELECT book_id, page_number, CASE WHEN doc_id % 10 = 3 THEN concat('Use page ', page_number) ELSE substring({CARD}, 1, 4500) END AS context FROM placed_v"""),
}
