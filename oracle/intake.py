"""Oracle SQL of intake, exports and single-row checks."""
from oracle.base import view, compose
from foliocheck.sources import seeds

WS = "chr(32) || chr(9) || chr(10) || chr(13)"
view("uploads_v", """SELECT page_id, CASE WHEN page_id % 9 = 8 THEN 'scan.png' ELSE concat('Book ', page_id, '.PDF') END AS file_name,
 CASE WHEN page_id % 11 = 10 THEN 0 WHEN page_id % 13 = 12 THEN 262144001 ELSE length(html) END AS size,
 CASE WHEN page_id % 10 = 3 THEN 'PK' ELSE '%PDF-' END AS magic,
 concat('proofreader_assets/pdf_', CASE WHEN page_id % 7 = 6 THEN 'a..b/' ELSE '' END, page_id) AS object_key,
 page_id % 70 AS parts FROM pages""")
view("keyok_v", r"""SELECT page_id, length(object_key) <= 300 AND regexp_matches(object_key, '^proofreader_assets/pdf_[A-Za-z0-9._-]+$')
  AND NOT contains(object_key, '..') AS key_ok FROM uploads_v""")
view("raw_issues_v", f"SELECT doc_id, {', '.join(f'{s} AS {n}' for n, s in seeds.raw_issue_columns())} FROM documents")
view("chat_v", f"SELECT conv_id, turn, {seeds.CHAT_TEXT} AS message FROM conversations WHERE role = 'user'")
view("marks_v", f"SELECT {seeds.book_id('//')} AS book_id, doc_id, {', '.join(f'{s} AS {n}' for n, s in seeds.MARK_COLUMNS)} FROM labels")
view("norm_v", f"""SELECT * FROM (SELECT doc_id, raw_type, raw_severity, raw_confidence, bn, b0, b1, b2, b3,
  trim(coalesce(quote, ''), {WS}) AS quote, trim(coalesce(suggestion, ''), {WS}) AS suggestion,
  trim(coalesce(explanation, ''), {WS}) AS explanation FROM raw_issues_v) WHERE NOT (quote = '' AND explanation = '')""")
view("review_v", """SELECT *, CASE severity WHEN 'major' THEN 'high' WHEN 'minor' THEN 'low' WHEN 'critical' THEN 'critical' ELSE 'medium' END AS sev,
 CASE WHEN type IN ('spelling','grammar','punctuation','wording','flow') THEN 'Grammar'
  WHEN type IN ('chapter_alignment','unit_alignment','heading') THEN 'Structure' WHEN type = 'learning_outcomes' THEN 'Pedagogy'
  WHEN type IN ('number','page_number','factual','examples') THEN 'Accuracy'
  WHEN type IN ('image','alignment','layout','spacing','overflow') THEN 'Formatting' ELSE 'Style' END AS category,
 status IN ('accepted','fixed') AS resolved, status = 'dismissed' AS ignored,
 box_source <> 'unverified' AND xmin >= 0 AND ymin >= 0 AND xmax <= 1000 AND ymax <= 1000 AND xmax > xmin AND ymax > ymin AS valid
 FROM findings_v""")
view("errors_v", f"SELECT event_id, {seeds.ERROR_MESSAGE} AS error FROM events")


def squash(c):
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def tokens(c):
    return (rf"regexp_extract_all(lower(regexp_replace(regexp_replace({c}, '(\p{{L}})(\p{{N}})', '\1 \2', 'g'), "
            rf"'(\p{{N}})(\p{{L}})', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+')")


def side(i, default):
    full = "(bn IS NOT NULL AND bn >= 4)"
    return f"least(1000.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN {full} THEN coalesce(b{i}, 0) ELSE {default}.0::DOUBLE END))"


view("box_v", f"""SELECT doc_id, ymin, xmin, CASE WHEN ymax <= ymin THEN least(1000.0::DOUBLE, ymin + 30) ELSE ymax END AS ymax,
 CASE WHEN xmax <= xmin THEN least(1000.0::DOUBLE, xmin + 40) ELSE xmax END AS xmax FROM
 (SELECT doc_id, {side(0, 0)} AS ymin, {side(1, 0)} AS xmin, {side(2, 1000)} AS ymax, {side(3, 1000)} AS xmax FROM norm_v)""")
view("clean_v", rf"""SELECT uid, {squash("replace(nfkc_q, chr(8722), '-')")} AS q, {squash("replace(nfkc_s, chr(8722), '-')")} AS s
 FROM (SELECT uid, quote AS nfkc_q, suggestion AS nfkc_s FROM findings_v)""")
view("edit1_v", """SELECT uid, q, s, CASE WHEN q = '' OR s = '' OR q = s THEN NULL ELSE coalesce(
  list_min(list_filter(range(1, least(length(q), length(s)) + 1), lambda k: substring(q, k, 1) <> substring(s, k, 1))) - 1,
  least(length(q), length(s))) END AS st FROM clean_v""")
view("edit_v", """SELECT uid, CAST(st AS INT) AS start, substring(q, st + 1, length(q) - st - en) AS before,
  substring(s, st + 1, length(s) - st - en) AS after FROM (SELECT *, coalesce(
  list_min(list_filter(range(1, least(length(q), length(s)) - st + 1), lambda k: substring(q, length(q) - k + 1, 1) <> substring(s, length(s) - k + 1, 1))) - 1,
  least(length(q), length(s)) - st) AS en FROM edit1_v)""")
BUILT = ["do not rewrite.*style", "only flag objective errors", "no space.*heading.*colon",
         "no colon.*before.*(?:and|conjunction)", "return.*exact quote", "check.*punctuation"]
view("instr_v", rf"""SELECT conv_id, turn, idx, p, CASE WHEN {' OR '.join(f"regexp_matches(p, '(?i){b}')" for b in BUILT)} THEN ''
   ELSE trim(regexp_replace(lower(p), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) END AS k FROM (
  SELECT conv_id, turn, trim(unnest(parts)) AS p, unnest(range(len(parts))) AS idx FROM (
   SELECT conv_id, turn, string_split(regexp_replace(regexp_replace({seeds.INSTRUCTION_TEXT}, '[\x00-\x1F]', ' ', 'g'),
     '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM conversations)) WHERE p <> ''""")
MEASURED = "coalesce(box_source IN ('pdf_text','ocr_text'), false)"

ORACLES = {
    "a1_intake_manifest": compose("""SELECT page_id, reason IS NULL AS ok, reason FROM (SELECT page_id, CASE
      WHEN NOT lower(file_name) LIKE '%.pdf' THEN 'name' WHEN size <= 0 THEN 'empty' WHEN size > 262144000 THEN 'too large'
      WHEN NOT key_ok THEN 'key' WHEN NOT parts BETWEEN 1 AND 64 THEN 'parts' WHEN magic <> '%PDF-' THEN 'magic' END AS reason
      FROM uploads_v JOIN keyok_v USING (page_id))"""),
    "a2_assemble_parts": """WITH p AS (SELECT page_id, html, CAST(ceil(length(html) / 4000.0) AS INT) AS declared,
        unnest(range(CAST(ceil(length(html) / 4000.0) AS INT))) AS idx FROM pages),
      q AS (SELECT *, substring(html, idx * 4000 + 1, 4000) AS body FROM p WHERE NOT (page_id % 6 = 5 AND idx = 1)),
      g AS (SELECT page_id, max(declared) AS declared, count(*) AS received, max(idx) AS last,
            string_agg(body, '' ORDER BY idx) AS body FROM q GROUP BY page_id)
      SELECT page_id, declared, received, received = declared AND last + 1 = declared AS complete,
       CASE WHEN received = declared AND last + 1 = declared THEN sha256(body) END AS digest,
       CASE WHEN received = declared AND last + 1 = declared THEN CAST(length(body) AS INT) END AS chars FROM g""",
    "a3_expand_pages": compose("SELECT book_id, CAST(unnest(range(1, page_count + 1)) AS INT) AS page_number, 'pending' AS status FROM books_v"),
    "a4_recent_books": compose("SELECT book_id, title, created_s FROM books_v ORDER BY created_s DESC, book_id LIMIT 100"),
    "b1_normalize_findings": compose("""SELECT doc_id, CASE WHEN raw_type IN ('spelling','heading','image') THEN raw_type ELSE 'other' END AS type,
      CASE WHEN raw_severity IN ('critical','major','minor') THEN raw_severity ELSE 'major' END AS severity, quote, suggestion, explanation,
      CASE WHEN bn = 4 AND b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL THEN 'ai' ELSE 'unverified' END AS box_source,
      'ai' AS source, 'open' AS status, CASE WHEN raw_confidence IS NULL THEN 0.7::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, raw_confidence)) END AS confidence
      FROM norm_v"""),
    "b2_clamp_box": compose("""SELECT doc_id, xmin, ymin, xmax, ymax, y1 > ymin AND x1 > x0 AS has_area,
      CASE WHEN y1 > ymin AND x1 > x0 THEN x0 END AS cut_xmin, CASE WHEN y1 > ymin AND x1 > x0 THEN x1 END AS cut_xmax
      FROM (SELECT *, greatest(0, least(1000, xmin - 15)) AS x0, greatest(greatest(0, least(1000, xmin - 15)), least(1000, xmax + 15)) AS x1,
        greatest(ymin, least(1000, ymin + (doc_id % 3) * 10)) AS y1 FROM box_v)"""),
    "b3_review_view": compose("""SELECT uid, page_number, sev AS severity, category, CASE WHEN valid THEN round(xmin / 10, 6) END AS x,
      CASE WHEN valid THEN round(ymin / 10, 6) END AS y, CASE WHEN valid THEN round((xmax - xmin) / 10, 6) END AS w,
      CASE WHEN valid THEN round((ymax - ymin) / 10, 6) END AS h, resolved, ignored FROM review_v"""),
    "b5_classify_error": compose(r"""SELECT event_id, CASE WHEN error = '' THEN ''
       WHEN internal THEN 'The model failed on its side; processing stops here so that it is not asked again and again.'
       WHEN regexp_matches(error, 'DEADLINE|504|timed out|aborted') THEN 'No answer from the model in time; processing stops here so that it is not asked again and again.'
       WHEN regexp_matches(error, '429|RESOURCE_EXHAUSTED') THEN 'The model takes no more requests for now; processing stops here until it does.'
       WHEN starts_with(trim(error), '{') THEN coalesce(CASE WHEN json_valid(error) THEN json_extract_string(error, '$.error.message') END, 'The page could not be analysed')
       WHEN length(error) > 140 THEN substring(error, 1, 140) || '…' ELSE error END AS friendly, fatal AS fatal_auth,
       NOT regexp_matches(error, 'ENOENT|no such file') AND NOT fatal AND (internal OR
        regexp_matches(error, '429|RESOURCE_EXHAUSTED|timed out|DEADLINE|504|UNAVAILABLE|503|500|fetch failed|aborted|JSON_PARSE_ERROR')) AS retryable
      FROM (SELECT *, regexp_matches(error, '(?i)internal error') AS internal,
        regexp_matches(error, '(?i)\b401\b|UNAUTHENTICATED|invalid_api_key|Incorrect API key') OR (contains(error, '403') AND contains(error, 'PERMISSION_DENIED'))
        OR regexp_matches(error, '(?i)denied access') OR regexp_matches(error, 'API key not valid|API_KEY_INVALID') AS fatal FROM errors_v)"""),
    "b6_rule_tag": compose("""SELECT uid, CASE
      WHEN contains(e, 'space before the colon') OR contains(q, ':-') OR (contains(q, ':') AND contains(e, 'heading')) THEN 'Heading Colon Rule'
      WHEN contains(e, 'colon before') OR (contains(q, ':') AND contains(e, 'conjunction')) THEN 'Conjunction Colon Rule'
      WHEN type = 'page_number' OR contains(e, 'page number') THEN 'Sequence Check'
      WHEN category = 'Formatting' AND contains(e, 'alignment') THEN 'Alignment Check' WHEN type = 'flow' THEN 'Sentence Flow' END AS rule_tag
      FROM (SELECT *, lower(explanation) AS e, lower(quote) AS q FROM review_v)"""),
    "b7_location_tokens": compose(f"""SELECT book_id, page_number, CAST(len(t) AS BIGINT) AS tokens, sha256(array_to_string(t, ' ')) AS digest
      FROM (SELECT book_id, page_number, {tokens('text')} AS t FROM pages_v)"""),
    "b8_clip_slug_squash": compose(rf"""SELECT book_id, page_number, CASE WHEN length(t) <= 200 THEN t
        ELSE substring(t, 1, 136) || ' ... ' || right(t, 59) END AS clipped,
      substring(regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70) AS slug, CAST(length(t) AS BIGINT) AS chars
      FROM (SELECT book_id, page_number, {squash('text')} AS t FROM pages_v)"""),
    "b9_requires_literal_match": compose(f"""SELECT uid, coalesce(suggestion, '') <> '' AND {squash('quote')} <> {squash('suggestion')}
      AND array_to_string({tokens('quote')}, ' ') = array_to_string({tokens('suggestion')}, ' ') AS literal FROM findings_v"""),
    "b10_minimal_edit": compose("SELECT uid, before, after, start FROM edit_v"),
    "b11_compile_instructions": compose("""SELECT conv_id, turn, substring(coalesce(string_agg(substring(p, 1, 500), chr(10) ORDER BY idx) FILTER (WHERE keep), ''), 1, 2000) AS text,
      CAST(count(*) FILTER (WHERE NOT keep) AS BIGINT) AS ignored
      FROM (SELECT *, k <> '' AND row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY idx) = 1 AS keep FROM instr_v) GROUP BY conv_id, turn"""),
    "b12_check_marks": compose("""SELECT book_id, count(*) AS marks, count(*) FILTER (WHERE bad) AS invalid, count(*) FILTER (WHERE bad) = 0 AND count(*) <= 10000 AS accepted
      FROM (SELECT m.*, count(*) OVER (PARTITION BY m.book_id, mark_id) > 1 OR mark_type NOT IN ('circle','square','highlight')
        OR page < 1 OR page > page_count OR mx < 0 OR my < 0 OR mw <= 0 OR mh <= 0 OR mx + mw > 100.01 OR my + mh > 100.01 AS bad
        FROM marks_v m JOIN books_v b ON m.book_id = b.book_id) GROUP BY book_id"""),
    "b13_check_keys": compose("""SELECT page_id, regexp_matches(hex_id, '(?i)^[a-f0-9]{24}$') AS id_ok, page_id % 5 - 1 >= 1 AS page_ok, key_ok, parts BETWEEN 1 AND 64 AS parts_ok
      FROM (SELECT *, CASE WHEN page_id % 8 = 7 THEN 'xyz' ELSE substring(md5(CAST(page_id AS VARCHAR)), 1, 24) END AS hex_id FROM uploads_v)
      JOIN keyok_v USING (page_id)"""),
    "b14_book_defaults": compose(rf"""SELECT page_id, substring(CASE WHEN t = '' THEN 'Untitled proofread' ELSE t END, 1, 180) AS title,
      substring(url, 1, 220) AS original_name, substring(trim(concat('  ', substring(html, 1, 120)), {WS}), 1, 80) AS class_level,
      substring(trim(url), 1, 100) AS subject, CASE page_id % 4 WHEN 0 THEN 'english' WHEN 2 THEN 'hindi' ELSE 'auto' END AS language,
      CASE page_id % 3 WHEN 0 THEN 'story' ELSE 'textbook' END AS book_type
      FROM (SELECT *, trim(CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '(?i)\.pdf$', '') WHEN 1 THEN '   ' ELSE html END, {WS}) AS t FROM pages)"""),
    "b15_location_phrase": compose(f"""SELECT uid, CASE WHEN {MEASURED} AND xmin IS NOT NULL THEN
      concat(CASE WHEN (xmin + xmax) / 2 < 500 THEN 'left' ELSE 'right' END, ' side, ', CASE WHEN (ymin + ymax) / 2 < 330 THEN 'upper'
      WHEN (ymin + ymax) / 2 > 660 THEN 'lower' ELSE 'middle' END, ' part of the page') ELSE 'no measured place; look for it on the page' END AS location
      FROM findings_v"""),
}
