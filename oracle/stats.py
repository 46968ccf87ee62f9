"""Oracle SQL of exports, predicates, totals and work state."""
from oracle.base import view, compose
from oracle.intake import tokens, MEASURED
from foliocheck.sources import seeds

LANG = "('spelling','grammar','punctuation','typography','heading','wording')"
REP = "('spelling','grammar','punctuation','typography','inconsistency','wording')"
view("page_agg_v", """SELECT book_id, count(*) AS pages, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'error') AS failed,
 count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
 count(*) FILTER (WHERE evidence_prepared) AS indexed, min(page_number) FILTER (WHERE status = 'processing') AS pp FROM pages_v GROUP BY book_id""")
view("attempts_v", f"""SELECT {seeds.book_id('//')} AS book_id, {seeds.PAGE_NUMBER} AS page_number, event_id, ts, event_type = 'error' AS failed,
 CASE WHEN event_type = 'error' THEN {seeds.ERROR_MESSAGE} END AS error FROM (SELECT *, event_id // 10 AS doc_id FROM events)""")
view("flags_v", """SELECT b.book_id, b.status, b.approved, g.* EXCLUDE (book_id), NOT needs_evidence AND running_unprepared AS preparing
 FROM books_v b JOIN (SELECT book_id, bool_or(status = 'pending') AS has_pending, bool_or(status = 'pending' AND NOT evidence_prepared) AS needs_evidence,
  bool_or(status = 'processing' AND NOT evidence_prepared) AS running_unprepared FROM pages_v GROUP BY book_id) g ON b.book_id = g.book_id""")
view("bucket_v", """SELECT *, CASE WHEN regexp_matches(lower(category), 'grammar|spell|syntax|punctuation|typograph|word') THEN 'Syntax Health'
 WHEN regexp_matches(lower(category), 'format|layout|pedagog|structure|align|curricul') THEN 'Curriculum Alignment'
 WHEN regexp_matches(lower(category), 'fact|accura|logic|math|reason') THEN 'Fact Accuracy' ELSE 'Style & Consistency' END AS bucket FROM review_v""")
view("scores_v", """SELECT book_id, bucket, coalesce(n, 0) AS open_findings, CAST(greatest(0, 100 - 4 * coalesce(n, 0)) AS BIGINT) AS score
 FROM (SELECT book_id, unnest(['Syntax Health','Curriculum Alignment','Fact Accuracy','Style & Consistency']) AS bucket FROM books_v)
 LEFT JOIN (SELECT book_id, bucket, count(*) AS n FROM bucket_v WHERE NOT resolved AND NOT ignored GROUP BY ALL) USING (book_id, bucket)""")
view("fstats_v", """SELECT book_id, count(*) AS findings, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'major') AS major,
 count(*) FILTER (WHERE severity = 'minor') AS minor, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'dismissed') AS dismissed
 FROM findings_v GROUP BY book_id""")
view("subjects_v", """SELECT book_id, string_agg(subject_key, ', ' ORDER BY first) AS subjects FROM
 (SELECT book_id, subject_key, min(page_number) AS first FROM pages_v WHERE subject_key <> '' GROUP BY ALL) GROUP BY book_id""")


def q(c):
    return f"""'"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '"', '""') || '"'"""


def fold(c):
    return (f"regexp_replace(replace(translate({c}, '“”‘’—–', '\"\"' || chr(39) || chr(39) || '--'), '…', '...'), "
            r"'[^\x00-\x7F]', '', 'g')")


ORACLES = {
    "a5_book_snapshot": compose("""SELECT book_id, title, count(*) AS pages, string_agg(CAST(page_number AS VARCHAR) || ':' || status || ':' || coalesce(types, ''), ';' ORDER BY page_number) AS content
      FROM (SELECT b.book_id, b.title, p.page_number, p.status, f.types FROM books_v b JOIN pages_v p ON p.book_id = b.book_id
       LEFT JOIN (SELECT book_id, page_number, string_agg(type, ',' ORDER BY seq, uid) AS types FROM findings_v GROUP BY ALL) f
         ON f.book_id = p.book_id AND f.page_number = p.page_number) GROUP BY ALL"""),
    "a6_export_findings": compose(f"""SELECT book_id, seq, page_number AS page, confidence,
      {" || ',' || ".join(q(c) for c in ("page_number", "type", "severity", "quote", "suggestion", "explanation", "status"))} AS line
      FROM findings_v WHERE status = 'accepted'"""),
    "a7_export_review_csv": compose("""SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_number, seq, uid) AS INT) AS id, category, type, sev AS severity,
      quote AS original_text, suggestion AS suggested_text, explanation, page_number AS page,
      CASE WHEN resolved THEN 'Resolved' WHEN ignored THEN 'Ignored' ELSE 'Pending' END AS status FROM review_v"""),
    "a8_annotation_sheet": compose(f"""WITH n AS (SELECT book_id, page_number, 0 AS k, id, CASE WHEN valid THEN ymin / 10 END AS y, '[A' || id || '] ' || category AS label,
        {fold('''concat_ws(' | ', CASE WHEN quote <> '' THEN 'Found: "' || quote || '"' END, CASE WHEN suggestion <> '' THEN 'Fix: ' || suggestion END, CASE WHEN explanation <> '' THEN 'Why: ' || explanation END)''')} AS body
        FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_number, seq, uid) AS id FROM review_v) WHERE NOT ignored
       UNION ALL SELECT book_id, page, 1, id, my, '[M' || id || '] ' || CASE WHEN mark_type = 'highlight' THEN 'Text Highlight' ELSE mark_type || ' Mark' END,
        {fold("'Note: ' || comment")} FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS id FROM marks_v))
      SELECT book_id, page_number, CAST(row_number() OVER (PARTITION BY book_id, page_number ORDER BY coalesce(y, 0), k, id) AS INT) AS place, label, body FROM n"""),
    "c1_has_native_evidence": compose(r"""SELECT *, letters >= 120 AND words >= 25 AS native FROM (SELECT book_id, page_number,
      CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS BIGINT) AS letters, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words FROM pages_v)"""),
    "c2_partition_grounded": compose(f"SELECT uid, NOT ((source = 'linter' OR type IN {LANG}) AND NOT {MEASURED}) AS verified FROM findings_v"),
    "c4_usable_box": compose(f"""SELECT uid, xmin, ymin, xmax, ymax FROM findings_v WHERE {MEASURED} AND xmin IS NOT NULL AND xmax > xmin AND ymax > ymin
      AND (xmax - xmin) * (ymax - ymin) <= 400000"""),
    "c5_visible_overlays": compose("SELECT uid, page_number, round(xmin / 10, 6) AS x, round(ymin / 10, 6) AS y FROM review_v WHERE valid AND NOT ignored"),
    "c6_important_warnings": compose("SELECT book_id, page_number, warning FROM pages_v WHERE warning <> '' AND NOT regexp_matches(lower(warning), 'candidates|first-pass')"),
    "c7_textual_repeatable": compose(f"""SELECT uid, trim(quote) <> '' AND type NOT IN ('image','alignment','layout','spacing','overflow') AS textual,
      type IN {REP} AND len(a) >= 2 AND len(b) > 0 AND quote <> suggestion AND len(a) = len(b) AND same >= len(a) - 1 AND same / len(a) >= 0.5 AS repeatable
      FROM (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) AS same
        FROM (SELECT *, {tokens('quote')} AS a, {tokens('suggestion')} AS b FROM findings_v))"""),
    "c8_pending_verification": compose(f"SELECT uid, NOT {MEASURED} AND type IN {LANG} AS pending FROM findings_v"),
    "c10_contents_page": compose(r"""SELECT book_id, page_number, regexp_matches(substring(text, 1, 1000), '(?i)\b(?:contents|table of contents|index)\b') AS heading,
      regexp_matches(text, '(?i)\b(?:Table\s+of\s+Contents|Contents|INDEX)\b|विषय[ -]सूची') AS printed FROM pages_v"""),
    "c11_is_indexed": compose("SELECT book_id, page_number, evidence_indexed OR length(text) >= 180 AS indexed FROM pages_v"),
    "f1_book_status": compose("""SELECT book_id, pages, done, failed, pending, processing, indexed, coalesce(CAST(pp AS BIGINT), done) AS current,
      CASE WHEN old IN ('paused','context_approval') OR (old IN ('done','error') AND ns IN ('queued','processing')) THEN old ELSE ns END AS status FROM
      (SELECT a.*, b.status AS old, CASE WHEN pending + processing = 0 THEN CASE WHEN failed = pages THEN 'error' ELSE 'done' END
        WHEN processing > 0 THEN 'processing' ELSE 'queued' END AS ns FROM page_agg_v a JOIN books_v b ON a.book_id = b.book_id)"""),
    "f2_finding_stats": compose("SELECT * FROM fstats_v"),
    "f3_review_summary": compose("""SELECT b.book_id, b.status = 'done' AND failed = 0 AS success, pages_reviewed, page_count AS pages_expected, visual_pending,
      coalesce(issue_count, 0) AS issue_count, b.status = 'done' AND failed = 0 AND issue_count IS NULL AND all_clean AS print_ready,
      coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, subjects FROM books_v b
      JOIN (SELECT book_id, count(*) FILTER (WHERE status = 'done') AS pages_reviewed, count(*) FILTER (WHERE status = 'error') AS failed,
        count(*) FILTER (WHERE status <> 'done' OR warning <> '') AS visual_pending, bool_and(warning = '' AND coverage_complete) AS all_clean FROM pages_v GROUP BY book_id) p ON p.book_id = b.book_id
      LEFT JOIN (SELECT book_id, count(*) AS issue_count, count(*) FILTER (WHERE sev = 'critical') AS critical, count(*) FILTER (WHERE sev = 'high') AS high,
        count(*) FILTER (WHERE sev = 'medium') AS medium, count(*) FILTER (WHERE sev = 'low') AS low FROM review_v GROUP BY book_id) f ON f.book_id = b.book_id
      LEFT JOIN subjects_v s ON s.book_id = b.book_id"""),
    "f4_category_scores": compose("SELECT * FROM scores_v"),
    "f5_progress": compose("""SELECT book_id, expected, done, progress, CAST(CASE WHEN progress = 0 OR expected = 0 THEN 30 WHEN progress < 100
       THEN greatest(2, 3 * greatest(0, expected - done)) ELSE 0 END AS BIGINT) AS eta_seconds FROM (SELECT b.book_id, page_count AS expected, done,
       CAST(least(100, floor((done + failed) / page_count * 100 + 0.5)) AS BIGINT) AS progress FROM books_v b JOIN page_agg_v a ON a.book_id = b.book_id)"""),
    "f15_resolution_progress": compose("""SELECT book_id, coalesce(h, 0) + coalesce(m, 0) AS handled, coalesce(n, 0) + coalesce(m, 0) AS total FROM
      (SELECT book_id, count(*) FILTER (WHERE resolved OR ignored) AS h, count(*) AS n FROM review_v GROUP BY book_id)
      FULL JOIN (SELECT book_id, count(*) AS m FROM marks_v GROUP BY book_id) USING (book_id)"""),
    "f17_open_findings_per_page": compose("""SELECT book_id, page_number, coalesce(n, 0) AS open_findings, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY book_id) AS BIGINT) AS book_total
      FROM pages_v LEFT JOIN (SELECT book_id, page_number, count(*) FILTER (WHERE NOT resolved AND NOT ignored) AS n FROM review_v GROUP BY ALL) USING (book_id, page_number)"""),
    "w5_failure_streaks": compose(r"""SELECT event_id, book_id, failed, streak, failed AND (coalesce(fatal, false) OR streak >= 3) AS pause FROM (
      SELECT *, CASE WHEN failed THEN CAST(count(*) FILTER (WHERE failed) OVER (PARTITION BY book_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS streak,
        regexp_matches(error, '(?i)\b401\b|UNAUTHENTICATED|invalid_api_key|Incorrect API key') OR (contains(error, '403') AND contains(error, 'PERMISSION_DENIED')) AS fatal
      FROM (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY book_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM attempts_v))"""),
    "w6_fair_batch": compose("""SELECT book_id, page_number, CAST(turn AS INT) AS turn FROM (SELECT p.book_id, page_number, row_number() OVER (PARTITION BY p.book_id ORDER BY page_number) AS turn
      FROM pages_v p JOIN flags_v f ON f.book_id = p.book_id WHERE p.status = 'pending' AND f.status IN ('queued','processing') AND has_pending
       AND (needs_evidence OR (NOT preparing AND approved)) AND (NOT needs_evidence OR NOT evidence_prepared)) ORDER BY turn, md5(book_id) LIMIT 8"""),
    "w7_last_n": """SELECT conv_id, turn, role, from_end, from_end <= 30 AS shown, from_end <= 16 AS in_context FROM
      (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS from_end FROM conversations) WHERE from_end <= 100""",
    "j20_runnable_books": compose("""SELECT book_id, status FROM books_v WHERE status IN ('queued','processing')
      AND book_id IN (SELECT book_id FROM pages_v WHERE status = 'pending')"""),
    "s4_stale_attempts": compose("""SELECT p.book_id, p.page_number, 'pending' AS new_status FROM pages_v p JOIN (SELECT book_id, page_number,
       max(ts) FILTER (WHERE event_id % 7 <> 0) AS hb, min(ts) AS up FROM attempts_v GROUP BY ALL) a ON a.book_id = p.book_id AND a.page_number = p.page_number
      WHERE doc_id % 3 <> 0 AND coalesce(hb, up) < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 15 MINUTE"""),
    "s7_apply_requests": compose("""WITH r AS (SELECT event_id AS request_id, CASE event_type WHEN 'view' THEN 'reanalyze' WHEN 'click' THEN 'reanalyze'
        WHEN 'signup' THEN 'resume' WHEN 'purchase' THEN 'pause' END AS kind, concat('book-', lpad(CAST(event_id // 500 AS VARCHAR), 12, '0')) AS book_id,
        CAST(CASE WHEN event_type IN ('view','click') THEN event_id % 55 + 1 END AS INT) AS page_number FROM events)
      SELECT request_id, kind, r.book_id, r.page_number, p.status AS page_status, CASE WHEN p.status IS NULL THEN 'missing' WHEN p.status IN ('done','error')
         AND request_id = min(request_id) OVER (PARTITION BY r.book_id, r.page_number) THEN 'pending' ELSE 'conflict' END AS outcome
       FROM r LEFT JOIN pages_v p ON p.book_id = r.book_id AND p.page_number = r.page_number WHERE kind = 'reanalyze'
      UNION ALL SELECT request_id, kind, r.book_id, p.page_number, p.status, 'pending' FROM
        (SELECT min(request_id) AS request_id, kind, book_id FROM r WHERE kind = 'resume' GROUP BY ALL) r JOIN pages_v p ON p.book_id = r.book_id AND p.status = 'error'
      UNION ALL SELECT request_id, kind, book_id, NULL, NULL, 'paused' FROM r WHERE kind = 'pause'"""),
    "s8_approval_gate": compose("""SELECT book_id, status AS old_status, CASE WHEN w THEN 'context_approval' WHEN status = 'context_approval' AND approved THEN 'queued' ELSE status END AS status, w AS gated
      FROM (SELECT *, status IN ('queued','processing') AND has_pending AND NOT needs_evidence AND NOT preparing AND NOT approved AS w FROM flags_v)"""),
    "scorecard": compose("""SELECT s.*, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical, coalesce(major, 0) AS major, coalesce(minor, 0) AS minor,
      coalesce(accepted, 0) AS accepted, coalesce(dismissed, 0) AS dismissed FROM (SELECT book_id, max(score) FILTER (WHERE bucket = 'Syntax Health') AS syntax,
       max(score) FILTER (WHERE bucket = 'Curriculum Alignment') AS curriculum, max(score) FILTER (WHERE bucket = 'Fact Accuracy') AS facts,
       max(score) FILTER (WHERE bucket = 'Style & Consistency') AS style FROM scores_v GROUP BY book_id) s LEFT JOIN fstats_v f ON f.book_id = s.book_id"""),
}
