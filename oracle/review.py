"""Oracle SQL of identity and review state."""
from oracle.base import view, compose
from oracle.intake import MEASURED
from foliocheck.sources import seeds

TEXT = "('spelling','grammar','punctuation','page_number','heading','flow','examples','wording','typography','inconsistency','number')"
view("run2_v", """SELECT * REPLACE (CASE WHEN doc_id % 6 = 0 AND source = 'linter' THEN 'inconsistency' ELSE type END AS type, CASE WHEN source = 'ai' THEN xmin + 5 ELSE xmin END AS xmin,
  sha256(uid || '#2') AS uid, seq + 1000000000 AS seq, 'open' AS status) FROM findings_v WHERE doc_id % 4 <> 1""")
view("keyed_v", f"""SELECT f.*, e.q AS cq, e.s AS cs, e.before, e.after, e.start, text_start IS NOT NULL AND ({MEASURED} OR source = 'linter') AS verified, text_start + coalesce(e.start, 0) AS change_at,
  {MEASURED} AND xmin IS NOT NULL AND xmax > xmin AND ymax > ymin AND (xmax - xmin) * (ymax - ymin) <= 400000 AS usable
  FROM (SELECT * FROM findings_v UNION ALL BY NAME SELECT * FROM run2_v) f JOIN (SELECT DISTINCT f.quote, f.suggestion, c.q, c.s, e.before, e.after, e.start FROM findings_v f JOIN clean_v c ON c.uid = f.uid JOIN edit_v e ON e.uid = f.uid) e
   ON e.quote = f.quote AND e.suggestion = f.suggestion WHERE e.q <> ''""")
view("numbered_v", "SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_number, seq, uid) AS id FROM findings_v")
view("decisions_v", f"""SELECT e.book_id, e.page_number, CASE WHEN event_type = 'click' THEN concat('gone-', e.seq % 50) ELSE coalesce(uid, concat('none-', e.rank)) END AS uid, status, ts, e.seq FROM
  (SELECT {seeds.book_id('//')} AS book_id, {seeds.PAGE_NUMBER} AS page_number, ts, event_id AS seq, event_type, event_id % 3 AS rank,
    CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'dismissed' WHEN 'view' THEN 'open' WHEN 'signup' THEN 'fixed' ELSE 'accepted' END AS status
   FROM (SELECT *, event_id // 10 AS doc_id FROM events)) e
  LEFT JOIN (SELECT book_id, page_number, uid, row_number() OVER (PARTITION BY book_id, page_number ORDER BY seq, uid) - 1 AS rank FROM findings_v) f
   ON f.book_id = e.book_id AND f.page_number = e.page_number AND f.rank = e.rank""")
view("last_v", "SELECT book_id, page_number, uid, arg_max(status, (ts, seq)) AS decided FROM decisions_v GROUP BY ALL")
BOXES = "xmin, ymin, xmax, ymax"

ORACLES = {
    "j12_duplicate_pairs": compose(f"""SELECT DISTINCT l.uid AS l_uid, r.uid AS r_uid FROM keyed_v l JOIN keyed_v r ON l.book_id = r.book_id AND l.page_number = r.page_number AND (l.seq, l.uid) < (r.seq, r.uid)
      WHERE (l.type = r.type OR (l.type IN {TEXT} AND r.type IN {TEXT} AND l.verified AND r.verified)) AND (
       (l.change_at = r.change_at AND ((l.start IS NOT NULL AND r.start IS NOT NULL AND l.before = r.before AND l.after = r.after) OR (l.start IS NULL AND r.start IS NULL AND l.cq = r.cq AND l.cs = r.cs)))
       OR (l.type = r.type AND l.cq = r.cq AND l.cs = r.cs AND l.usable AND r.usable AND greatest(0, least(l.xmax, r.xmax) - greatest(l.xmin, r.xmin)) * greatest(0, least(l.ymax, r.ymax) - greatest(l.ymin, r.ymin))
          / least((l.xmax - l.xmin) * (l.ymax - l.ymin), (r.xmax - r.xmin) * (r.ymax - r.ymin)) >= .6))"""),
    "j15_apply_geometry": compose(f"""SELECT uid, id, CASE WHEN use THEN xmin ELSE nx END AS xmin, ymin, xmax, ymax, CASE WHEN use THEN box_source ELSE ns END AS box_source, status FROM (
      SELECT *, {MEASURED} AND xmin IS NOT NULL AND NOT (ns IN ('pdf_text','ocr_text') AND nx IS NOT NULL) AS use FROM (
       SELECT *, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN xmin + 1 END ELSE xmin END AS nx,
        CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'pdf_text' ELSE 'unverified' END ELSE box_source END AS ns FROM numbered_v))"""),
    "j16_merge_reviews": compose("""SELECT uid, s AS snapshot, CASE WHEN p IS NOT NULL THEN p = 'accepted' WHEN s = 'stale' AND doc_id % 3 <> 1 THEN NOT resolved ELSE resolved END AS resolved,
      CASE WHEN p IS NOT NULL THEN p = 'dismissed' WHEN s = 'stale' AND doc_id % 3 <> 1 THEN false ELSE ignored END AS ignored FROM
      (SELECT *, unnest(['fresh','stale']) AS s, CASE WHEN doc_id % 5 = 2 THEN CASE doc_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'dismissed' ELSE 'open' END END AS p FROM review_v)"""),
    "j17_stable_ids": compose("""SELECT book_id, page_number, uid, CAST(CASE WHEN doc_id % 3 <> 0 THEN id * 2 ELSE coalesce(top, 0) + fresh END AS BIGINT) AS id FROM
      (SELECT *, max(id * 2) FILTER (WHERE doc_id % 3 <> 0) OVER (PARTITION BY book_id) AS top, count(*) FILTER (WHERE doc_id % 3 = 0) OVER (PARTITION BY book_id ORDER BY id) AS fresh FROM numbered_v)"""),
    "j18_validate_issue_map": compose("""SELECT book_id, count(*) AS rows, count(*) FILTER (WHERE bad) AS bad_rows, count(*) FILTER (WHERE bad) = 0 AND count(*) <= 5000 AS accepted FROM (
      SELECT book_id, doc_id = 7 OR doc_id % 350 = 105 OR number > 5000 OR count(*) OVER (PARTITION BY book_id, number) > 1 OR count(*) OVER (PARTITION BY book_id, u) > 1 AS bad FROM
       (SELECT *, CASE WHEN doc_id = 7 THEN 'gone' ELSE uid END AS u, CASE WHEN doc_id % 400 = 63 THEN 6000 ELSE id END AS number FROM numbered_v)) GROUP BY book_id"""),
    "s2_apply_decisions": compose("""SELECT f.book_id, f.page_number, f.uid, coalesce(decided, status) AS status, 'finding' AS kind FROM findings_v f LEFT JOIN last_v l
       ON l.book_id = f.book_id AND l.page_number = f.page_number AND l.uid = f.uid
      UNION ALL SELECT l.book_id, l.page_number, l.uid, decided, 'unknown' FROM last_v l ANTI JOIN findings_v f ON l.book_id = f.book_id AND l.page_number = f.page_number AND l.uid = f.uid"""),
    "s3_commit_split": compose(f"""SELECT update_id, book_id, page_number, CASE WHEN refused THEN 'refused' WHEN ok AND update_id = min(update_id) FILTER (WHERE ok) OVER (PARTITION BY book_id, page_number)
       THEN 'accepted' ELSE 'stale' END AS outcome FROM (SELECT u.*, p.doc_id IS NULL OR run_id = 'revoked' AS refused, p.doc_id IS NOT NULL AND run_id <> 'revoked' AND base_revision = p.doc_id % 4 AS ok FROM
      (SELECT event_id AS update_id, {seeds.book_id('//')} AS book_id, {seeds.PAGE_NUMBER} AS page_number, event_id % 4 AS base_revision, CASE WHEN event_id % 13 = 0 THEN 'revoked' ELSE 'r' END AS run_id
        FROM (SELECT *, event_id // 7 AS doc_id FROM events)) u LEFT JOIN pages_v p ON p.book_id = u.book_id AND p.page_number = u.page_number)"""),
}
