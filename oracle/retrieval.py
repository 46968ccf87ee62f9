"""Oracle SQL of model answers, requests, retrieval, commands and streams."""
from oracle.base import view, compose
from oracle.intake import squash
from foliocheck import constants as C

view("salv_v", r"""SELECT *, CASE WHEN json_valid(raw) THEN raw WHEN json_valid(regexp_extract(raw, '(?s)\{.*\}', 0)) THEN regexp_extract(raw, '(?s)\{.*\}', 0) END AS j FROM responses_v""")
view("parsed_v", """SELECT *, CASE WHEN coalesce(finish_reason, 'STOP') NOT IN ('STOP','FINISH_REASON_UNSPECIFIED') THEN 'truncated or blocked'
  WHEN j IS NULL OR json_type(j, '$.issues') IS DISTINCT FROM 'ARRAY' THEN 'incomplete'
  WHEN contains(j, '"huge"') THEN 'invalid issue' END AS reject FROM salv_v""")
view("comp_v", """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'MAX_TOKENS' WHEN 1 THEN 'STOP' END AS finish, conv_id % 5 AS k FROM conversations WHERE role = 'assistant'""")
view("queries_v", "SELECT conv_id * 100 + turn AS query_id, concat('book-', lpad(CAST(conv_id // 7 AS VARCHAR), 12, '0')) AS book_id, turn % 50 + 1 AS current, message FROM chat_v")
REF = r"(?i)\bissues?\s*(?:numbers?|nos?\.?|#)?\s*((?:\d+\s*(?:(?:,|and|&|-)\s*)?)+)"


def distinct_first(lst, n):
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)[1:{n}]"


view("refs_v", rf"SELECT conv_id, turn, list_transform(regexp_extract_all(regexp_extract(message, '{REF}', 1), '\d+'), lambda x: CAST(x AS BIGINT)) AS r FROM chat_v")
view("terms1_v", r"SELECT conv_id * 100 + turn AS query_id, regexp_extract_all(lower(message), '[\p{L}\p{N}]{3,}') AS t FROM chat_v")
STOP = "[" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + "]"
view("terms_v", f"SELECT query_id, list_filter(list_filter(t, lambda x, i: list_position(t, x) = i), lambda x: NOT list_contains({STOP}, x))[1:12] AS t FROM terms1_v")
view("records_v", """SELECT book_id, uid, page_number, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_number, seq, uid) AS BIGINT) AS number, lower(concat_ws(' ',
  'uid sidebarNumber page type severity quote suggestion explanation status box boxSource xmin ymin xmax ymax seenInLatestAnalysis', uid, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_number, seq, uid) AS VARCHAR),
  CAST(page_number AS VARCHAR), type, severity, substring(quote, 1, 600), substring(suggestion, 1, 600), substring(explanation, 1, 600), status, box_source)) AS record FROM findings_v""")

# Sentences in parts of 700 characters, numbered per page; `first` and `n` speak of the whole sentence.
view("chunk_parts_v", rf"""SELECT book_id, page_number, row_number() OVER (PARTITION BY book_id, page_number ORDER BY s_no, o) AS k, o = 0 AS first, n, substring(s, CAST(o + 1 AS BIGINT), 700) AS part
  FROM (SELECT book_id, page_number, s_no, s, length(s) AS n, unnest(range(0, greatest(1, length(s)), 700)) AS o FROM (
    SELECT book_id, page_number, unnest(l) AS s, unnest(range(len(l))) AS s_no FROM (
      SELECT book_id, page_number, string_split(regexp_replace(t, '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM (SELECT book_id, page_number, {squash("text")} AS t FROM pages_v) WHERE t <> '')))""")

view("page_chunks_v", """SELECT * FROM (
        WITH RECURSIVE pack AS (
          SELECT book_id, page_number, CAST(0 AS BIGINT) AS k, '' AS cur, CAST([] AS VARCHAR[]) AS done FROM chunk_parts_v WHERE k = 1
          UNION ALL
          SELECT p.book_id, p.page_number, p.k, CASE WHEN full_again OR cur1 = '' THEN p.part ELSE cur1 || ' ' || p.part END,
                 CASE WHEN full_again THEN list_append(done1, trim(cur1)) ELSE done1 END
          FROM (SELECT q.*, length(cur1) + length(q.part) > 700 AS full_again FROM (
            SELECT c.*, CASE WHEN whole THEN '' ELSE c.cur END AS cur1, CASE WHEN whole THEN list_append(c.done, trim(c.cur)) ELSE c.done END AS done1 FROM (
              SELECT x.book_id, x.page_number, x.k, x.part, a.cur, a.done, x.first AND a.cur <> '' AND length(a.cur) + x.n > 700 AS whole
              FROM pack a JOIN chunk_parts_v x ON x.book_id = a.book_id AND x.page_number = a.page_number AND x.k = a.k + 1) c) q) p)
        SELECT book_id, page_number, CASE WHEN cur <> '' THEN list_append(done, trim(cur)) ELSE done END AS chunks FROM pack
        QUALIFY row_number() OVER (PARTITION BY book_id, page_number ORDER BY k DESC) = 1)""")

ORACLES = {
    "w9_chunk_text": compose("""SELECT book_id, page_number, CAST(i - 1 AS INT) AS chunk_no, CAST(length(chunks[i]) AS INT) AS chars, sha256(chunks[i]) AS digest FROM (
      SELECT book_id, page_number, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM page_chunks_v)"""),
    "w10_retrieve_context": compose(f"""SELECT query_id, CAST(length(context) AS INT) AS chars, sha256(context) AS digest FROM (
      SELECT query_id, substring(array_to_string(picks, chr(10) || chr(10)), 1, 12000) AS context FROM (
        WITH RECURSIVE asked AS (
          SELECT q.query_id, q.message, {squash("CASE WHEN q.query_id % 3 = 0 THEN substring(p.text, 1, 40) ELSE '' END")} AS picked, coalesce(c.chunks, CAST([] AS VARCHAR[])) AS chunks
          FROM queries_v q JOIN pages_v p ON p.book_id = q.book_id AND p.page_number = q.current
          LEFT JOIN page_chunks_v c ON c.book_id = p.book_id AND c.page_number = p.page_number),
        worded AS (SELECT *, regexp_extract_all(lower(concat_ws(' ', message, picked)), '[\\p{{L}}\\p{{N}}]{{3,}}') AS w FROM asked),
        termed AS (SELECT *, list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: NOT list_contains({STOP}, x))[1:12] AS terms FROM worded),
        split AS (SELECT query_id, terms, unnest(chunks) AS c, unnest(range(len(chunks))) AS i FROM termed),
        ranked AS (SELECT query_id, c, row_number() OVER (PARTITION BY query_id ORDER BY len(list_filter(terms, lambda t: contains(lower(c), t))) DESC, i) AS k FROM split),
        fill AS (
          SELECT query_id, CAST(0 AS BIGINT) AS k, length(picked) AS used, CASE WHEN picked <> '' THEN ['User-selected text: ' || picked] ELSE CAST([] AS VARCHAR[]) END AS picks FROM termed
          UNION ALL
          SELECT f.query_id, r.k, CASE WHEN len(picks) < 18 AND used + length(r.c) <= 12000 THEN used + length(r.c) ELSE used END,
                 CASE WHEN len(picks) < 18 AND used + length(r.c) <= 12000 THEN list_append(picks, r.c) ELSE picks END
          FROM fill f JOIN ranked r ON r.query_id = f.query_id AND r.k = f.k + 1)
        SELECT query_id, picks FROM fill QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1))"""),
    "a12_parse_model_findings": compose("""SELECT doc_id, reject, CASE WHEN reject IS NULL THEN CAST(json_array_length(j, '$.issues') AS BIGINT) END AS issues,
      CASE WHEN reject IS NULL THEN json_extract_string(j, '$.issues[0].quote') END AS quote, CASE WHEN reject IS NULL THEN json_extract_string(j, '$.issues[1].type') END AS type,
      CASE WHEN reject IS NULL THEN CAST(json_extract(j, '$.issues[0].box_2d[2]') AS DOUBLE) END AS ymax FROM parsed_v"""),
    "a13_parse_companion": compose("""SELECT conv_id, turn, r AS reject, CASE WHEN r IS NULL THEN CASE k WHEN 0 THEN concat('Turn ', turn) ELSE 'Verified' END END AS answer,
      CASE WHEN r IS NULL THEN CAST(CASE k WHEN 0 THEN 1 ELSE 0 END AS BIGINT) END AS observations, CASE WHEN r IS NULL AND k = 0 THEN concat('a ', conv_id) END AS quote
      FROM (SELECT *, CASE WHEN finish = 'MAX_TOKENS' THEN 'incomplete' WHEN k = 4 THEN 'invalid' WHEN k IN (2, 3) THEN 'no evidence' END AS r FROM comp_v)"""),
    "a14_build_request_pack": compose("""WITH k AS (SELECT book_id, page_number, substring(string_agg('- ' || substring(text, 1, 240), chr(10) ORDER BY seq), 1, 1800) AS knowledge FROM (
       SELECT p.book_id, p.page_number, k.seq, k.text, row_number() OVER (PARTITION BY p.book_id, p.page_number ORDER BY k.seq DESC) AS r FROM pages_v p JOIN know_v k ON k.book_id = p.book_id
        AND (scope = 'book' OR (scope = 'page' AND k.page_number = p.page_number))) WHERE r <= 12 GROUP BY ALL),
      f AS (SELECT book_id, page_number, substring('[' || string_agg(CAST(to_json(struct_pack(type := type, quote := quote, suggestion := suggestion, status := status)) AS VARCHAR), ',' ORDER BY seq, uid) || ']', 1, 14000) AS prior FROM findings_v GROUP BY ALL),
      x AS (SELECT book_id, page_number, substring(concat('Chapter: ', chapter_name, '; PDF pages ', start_page, '-', end_page, '; certainty of its limits ', conf, '.', chr(10), 'Pages read so far: ', indexed, '/', end_page - start_page + 1, ' chapter pages. ',
        CASE WHEN indexed < end_page - start_page + 1 THEN 'PARTIAL CONTEXT: the rest of the chapter has not been read.' ELSE 'The whole chapter has been read; long pages are cut below.' END, chr(10), substring(coalesce(body, ''), 1, 6600)), 1, 10000) AS c FROM excerpt_v)
      SELECT p.book_id, p.page_number, sha256(substring(p.text, 1, 24000)) AS transcript, sha256(x.c) AS context, CAST(length(k.knowledge) AS BIGINT) AS knowledge_chars, coalesce(f.prior, '[]') AS prior, 'Keep to the style sheet.' AS instructions
      FROM pages_v p LEFT JOIN x ON x.book_id = p.book_id AND x.page_number = p.page_number LEFT JOIN k ON k.book_id = p.book_id AND k.page_number = p.page_number LEFT JOIN f ON f.book_id = p.book_id AND f.page_number = p.page_number"""),
    "b17_parse_issue_refs": compose(f"SELECT conv_id, turn, array_to_string({distinct_first('r', 30)}, ',') AS refs FROM refs_v"),
    "b18_parse_command": compose(r"""SELECT conv_id, turn, kind, CAST(CASE kind WHEN 'navigate' THEN regexp_extract(message, '(\d+)[.!]?\s*$', 1) WHEN 'reanalyze' THEN regexp_extract(message, '(\d+)[.!]?\s*$', 1) END AS INT) AS page,
      CASE WHEN kind = 'remember' THEN substring(trim(regexp_extract(message, '(?is)^\s*(?:/remember|remember(?:\s+that)?)\s+(.+)$', 1)), 1, 500) END AS fact FROM (SELECT *, CASE
       WHEN regexp_matches(message, '(?is)^\s*(?:/remember|remember(?:\s+that)?)\s+(.+)$') THEN 'remember' WHEN regexp_matches(message, '(?i)^\s*(?:please\s+)?pause(?:\s+(?:the\s+)?analysis)?[.!]?\s*$') THEN 'pause'
       WHEN regexp_matches(message, '(?i)^\s*(?:please\s+)?resume(?:\s+(?:the\s+)?analysis)?[.!]?\s*$') THEN 'resume' WHEN regexp_matches(message, '(?i)^\s*(?:please\s+)?(?:go|open|show|navigate)\s+(?:to\s+)?page\s+(\d+)[.!]?\s*$') THEN 'navigate'
       WHEN regexp_matches(message, '(?i)^\s*(?:please\s+)?re-?analy[sz]e\s+page\s+(\d+)[.!]?\s*$') THEN 'reanalyze' END AS kind FROM chat_v)"""),
    "w8_rank_findings": compose("""SELECT query_id, uid, number, page_number, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, number, uid) AS place FROM (
      SELECT q.query_id, f.uid, f.number, f.page_number, CAST(CASE WHEN list_contains(r.r, f.number) THEN 10000 ELSE 0 END + CASE WHEN f.page_number = q.current THEN 5 ELSE 0 END
       + len(list_filter(t.t, lambda x: contains(f.record, x))) AS BIGINT) AS score FROM queries_v q JOIN terms_v t ON t.query_id = q.query_id JOIN refs_v r ON r.conv_id * 100 + r.turn = q.query_id JOIN records_v f ON f.book_id = q.book_id)) WHERE place <= 60"""),
    "s5_live_findings": """SELECT concat('book-', lpad(CAST(event_id // 500 AS VARCHAR), 12, '0')) AS book_id, CAST(event_id // 10 % 50 + 1 AS INT) AS page_number, CAST(event_id AS VARCHAR) AS uid,
      CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'low' END AS severity, CASE event_type WHEN 'click' THEN 'Grammar' WHEN 'view' THEN 'Structure' ELSE 'Formatting' END AS category,
      event_type = 'purchase' AS resolved, event_type = 'error' AS ignored FROM events""",
    "s6_live_stats": """SELECT concat('book-', lpad(CAST(event_id // 500 AS VARCHAR), 12, '0')) AS book_id, count(*) AS findings, count(*) FILTER (WHERE event_id % 3 = 0) AS critical, count(*) FILTER (WHERE event_id % 3 = 1) AS major,
      count(*) FILTER (WHERE event_id % 3 = 2) AS minor, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS dismissed FROM events GROUP BY 1""",
}
