"""Oracle SQL of phrase location and grounding."""
from oracle.base import view, compose
from oracle.intake import squash, tokens, MEASURED
from foliocheck.sources import seeds

TEXTUAL = "trim(quote) <> '' AND type NOT IN ('image','alignment','layout','spacing','overflow')"
SIGNED = r"regexp_matches(trim(quote), '^[+−-]\d+$')"
LITERAL = (f"(coalesce(suggestion, '') <> '' AND {squash('quote')} <> {squash('suggestion')} AND "
           f"array_to_string({tokens('quote')}, ' ') = array_to_string({tokens('suggestion')}, ' '))")
REPEAT = f"""(type IN ('spelling','grammar','punctuation','typography','inconsistency','wording') AND len({tokens('quote')}) >= 2
  AND quote <> suggestion AND len({tokens('quote')}) = len({tokens('suggestion')})
  AND len(list_filter(list_zip({tokens('quote')}, {tokens('suggestion')}), lambda z: z[1] = z[2])) >= len({tokens('quote')}) - 1
  AND len(list_filter(list_zip({tokens('quote')}, {tokens('suggestion')}), lambda z: z[1] = z[2])) / len({tokens('quote')}) >= .5)"""


def cs_tokens(c):
    return tokens(c).replace("lower(", "(", 1)


KEY = "book_id, page_number"


def peeled(p):
    """View {p}_ord_mat (keys, part, word_idx, ord) over {p}_parts: while words are left, the first from the top leads a line and takes all level with it."""
    view(f"{p}_peel", f"""SELECT {KEY}, part, word_idx, x, y, h, 0 AS line FROM {p}_parts UNION ALL
      SELECT {KEY}, part, word_idx, x, y, h, line + 1 FROM (SELECT *, first_value(y + h / 2) OVER w AS lead_mid, first_value(h) OVER w AS lead_h FROM {p}_peel
        WINDOW w AS (PARTITION BY {KEY}, part ORDER BY y, x, word_idx)) WHERE abs(y + h / 2 - lead_mid) > greatest(3.0::DOUBLE, 0.55::DOUBLE * least(h, lead_h))""")
    view(f"{p}_ord_mat", f"""SELECT {KEY}, part, word_idx, x, y, h, row_number() OVER (PARTITION BY {KEY}, part ORDER BY line, x, word_idx) - 1 AS ord
      FROM (SELECT {KEY}, part, word_idx, x, y, h, max(line) AS line FROM {p}_peel GROUP BY ALL)""")


def streams(p, words, grp="NULL"):
    """View {p}_st_mat (keys, stream, ord, word_idx): the reading orders of each page of a words view."""
    view(f"{p}_box", f"SELECT {KEY}, word_idx, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h, {grp} AS grp FROM {words}")
    view(f"{p}l_parts", f"SELECT *, 1 AS part FROM {p}_box")
    peeled(f"{p}l")
    view(f"{p}_gap", f"""SELECT {KEY}, ord, CAST(floor((x + w + nx) / 40 + 0.5) * 20 AS INT) AS cut FROM (SELECT o.*, b.w, lead(o.x) OVER n AS nx, lead(o.y) OVER n AS ny, lead(o.h) OVER n AS nh
      FROM {p}l_ord_mat o JOIN {p}_box b USING (book_id, page_number, word_idx) WINDOW n AS (PARTITION BY {KEY} ORDER BY ord)) WHERE abs(y - ny) < greatest(h, nh) AND nx - x - w > 35""")
    view(f"{p}_cut", f"""SELECT {KEY}, cut, row_number() OVER (PARTITION BY {KEY} ORDER BY count(*) DESC, min(ord)) AS turn FROM (SELECT * FROM {p}_gap WHERE cut > 180 AND cut < 820
      UNION ALL SELECT DISTINCT {KEY}, -1, 500 FROM {p}_box) GROUP BY {KEY}, cut QUALIFY turn <= 6""")
    view(f"{p}_par", f"""SELECT *, 1 + dense_rank() OVER (PARTITION BY {KEY} ORDER BY first) AS part FROM (SELECT *, min(word_idx) OVER (PARTITION BY {KEY}, grp) AS first FROM {p}_box WHERE grp IS NOT NULL)""")
    view(f"{p}c_parts", f"""SELECT {KEY}, word_idx, x, y, h, part FROM {p}_par UNION ALL
      SELECT {KEY}, word_idx, x, y, h, coalesce(last, 1) + 2 * turn - 1 + CASE WHEN x + w / 2 >= cut THEN 1 ELSE 0 END FROM {p}_box JOIN {p}_cut USING (book_id, page_number)
      LEFT JOIN (SELECT {KEY}, max(part) AS last FROM {p}_par GROUP BY ALL) USING (book_id, page_number)""")
    peeled(f"{p}c")
    view(f"{p}_st_mat", f"""SELECT {KEY}, 0 AS stream, row_number() OVER (PARTITION BY {KEY} ORDER BY word_idx) - 1 AS ord, word_idx FROM {p}_box
      UNION ALL SELECT {KEY}, part, ord, word_idx FROM {p}l_ord_mat UNION ALL SELECT {KEY}, part, ord, word_idx FROM {p}c_ord_mat""")


def ranked(name, words, source, orders=None):
    """Views {name}_rw (words by rank in each reading order, or as stored) and {name}_pt (their tokens)."""
    placed = f"{words} JOIN {orders}_st_mat USING (book_id, page_number, word_idx)" if orders else f"(SELECT *, 0 AS stream, word_idx AS ord FROM {words})"
    view(f"{name}_rw", f"""SELECT *, CAST(sum(n_tok) OVER w - n_tok AS BIGINT) AS tok_start, row_number() OVER w AS rank FROM
      (SELECT *, {source} AS src, len(toks) AS n_tok FROM (SELECT *, {cs_tokens('str')} AS toks FROM {placed}))
      WINDOW w AS (PARTITION BY book_id, page_number, stream ORDER BY ord)""")
    view(f"{name}_pt", f"""SELECT book_id, page_number, stream, rank, tok_start + unnest(range(len(toks))) AS pos, unnest(toks) AS tok_cs FROM {name}_rw""")


streams("nato", "words_v")
ranked("nat0", "words_v", "'pdf_text'")
ranked("nat", "words_v", "'pdf_text'", "nato")


def locate(p, quotes, rw, starts=None):
    """Views {p}_c (one row per start) and {p}_p (distinct places) for the quotes view."""
    base = rw
    view(f"{p}_qt", rf"""SELECT fid, book_id, page_number, k, unnest(q) AS q_cs, unnest(range(k)) AS j FROM
      (SELECT *, len(q) AS k FROM (SELECT *, {cs_tokens('quote')} AS q FROM {quotes}))
      WHERE k > 0 AND NOT (k = 1 AND regexp_matches(q[1], '^\d+$') AND NOT allow_numeric)""")
    view(f"{p}_s", starts or f"""SELECT fid, q.book_id, q.page_number, t.stream, pos - j AS start, min(rank) AS first, max(rank) AS last,
      count(*) FILTER (WHERE q_cs = tok_cs) = max(k) AS case_exact, true AS exact, 1.0::DOUBLE AS score
      FROM {p}_qt q JOIN {base}_pt t ON t.book_id = q.book_id AND t.page_number = q.page_number AND lower(t.tok_cs) = lower(q.q_cs)
      GROUP BY fid, q.book_id, q.page_number, t.stream, pos - j HAVING count(*) = max(k)""")
    joins = " ".join(f"LEFT JOIN {base}_rw {a}{i} ON {a}{i}.book_id = s.book_id AND {a}{i}.page_number = s.page_number AND {a}{i}.stream = s.stream AND {a}{i}.rank = s.{c} {o} {i}"
                     for a, c, o in (("l", "first", "-"), ("r", "last", "+")) for i in (1, 2, 3))
    view(f"{p}_n", f"""SELECT s.*, CASE WHEN coalesce(l1.n_tok, 1) <> 0 THEN 0 WHEN coalesce(l2.n_tok, 1) <> 0 THEN 1 WHEN coalesce(l3.n_tok, 1) <> 0 THEN 2 ELSE 3 END AS nl,
      CASE WHEN coalesce(r1.n_tok, 1) <> 0 THEN 0 WHEN coalesce(r2.n_tok, 1) <> 0 THEN 1 WHEN coalesce(r3.n_tok, 1) <> 0 THEN 2 ELSE 3 END AS nr FROM {p}_s s {joins}""")
    view(f"{p}_g", f"""SELECT g.fid, g.stream, g.start, g.i, g.j, string_agg(w.str, ' ' ORDER BY w.rank) AS txt FROM
      (SELECT *, unnest(range(nr + 1)) AS j FROM (SELECT *, unnest(range(nl + 1)) AS i FROM {p}_n)) g
      JOIN {base}_rw w ON w.book_id = g.book_id AND w.page_number = g.page_number AND w.stream = g.stream AND w.rank BETWEEN g.first - g.i AND g.last + g.j GROUP BY ALL""")
    view(f"{p}_k", f"""SELECT g.fid, g.stream, g.start, min(i * 10 + j) AS ij FROM {p}_g g JOIN {quotes} q ON q.fid = g.fid AND contains(g.txt, {squash('q.quote')}) GROUP BY ALL""")
    view(f"{p}_w", f"""SELECT n.fid, n.book_id, n.page_number, n.stream, n.start, n.case_exact, n.exact, n.score, k.ij IS NOT NULL AS literal_exact, w.rank, w.xmin, w.ymin, w.xmax, w.ymax,
      w.text_start, w.text_end, w.src FROM {p}_n n LEFT JOIN {p}_k k ON k.fid = n.fid AND k.stream = n.stream AND k.start = n.start
      JOIN {base}_rw w ON w.book_id = n.book_id AND w.page_number = n.page_number AND w.stream = n.stream AND w.rank BETWEEN n.first - coalesce(k.ij, 0) // 10 AND n.last + coalesce(k.ij, 0) % 10""")
    view(f"{p}_f", f"""SELECT *, first_value(xmin) OVER w AS sx, lag(xmin) OVER w AS px0, lag(xmax) OVER w AS px1, lag(ymin) OVER w AS py0, lag(ymax) OVER w AS py1,
      lag(text_end) OVER w AS pe, lag(src) OVER w AS ps FROM {p}_w WINDOW w AS (PARTITION BY fid, stream, start ORDER BY rank)""")
    view(f"{p}_c", f"""SELECT fid, book_id, page_number, stream, start, case_exact, exact, score, literal_exact, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax,
      arg_min(text_start, rank) AS text_start, arg_max(text_end, rank) AS text_end, CASE WHEN bool_and(src = 'ocr_text') THEN 'ocr_text' ELSE 'pdf_text' END AS source,
      bool_and(px0 IS NULL
       OR (abs(ymin - py0) <= tall * .65 AND xmin >= px0 - 3 AND xmin - px1 <= greatest(50, tall * 4))
       OR (ymin > py0 + tall * .4 AND ymin - py0 <= tall * 3.2 AND xmin >= sx - 35 AND xmin <= sx + 65)
       OR (src = 'pdf_text' AND ps = 'pdf_text' AND text_start >= pe AND text_start - pe <= 3 AND
           sqrt(pow(greatest(0, xmin - px1, px0 - xmax), 2) + pow(greatest(0, ymin - py1, py0 - ymax), 2)) <= greatest(15, 4 * least(px1 - px0, py1 - py0, xmax - xmin, ymax - ymin)))) AS continuous
      FROM (SELECT *, greatest(ymax - ymin, py1 - py0, 3) AS tall FROM {p}_f) GROUP BY ALL""")
    view(f"{p}_p", f"""SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY fid ORDER BY exact DESC, score DESC, ymin, xmin, stream, start) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY fid, round(xmin, 3), round(ymin, 3), round(xmax, 3), round(ymax, 3) ORDER BY stream, start) AS rn FROM {p}_c WHERE continuous AND xmax > xmin AND ymax > ymin) WHERE rn = 1""")


view("fq_v", f"SELECT uid AS fid, book_id, page_number, quote, source = 'linter' AS allow_numeric FROM findings_v WHERE {TEXTUAL}")
locate("lq", "fq_v", "nat0")
locate("la", "fq_v", "nat")


def ground(p, findings, rw):
    """Views {p}_q, {p}_* of the location and {p}_out: the grounded findings with their copies."""
    view(f"{p}_q", f"""SELECT uid AS fid, book_id, page_number, quote, {SIGNED} OR (source = 'linter' AND text_start IS NOT NULL) AS allow_numeric FROM {findings} WHERE {TEXTUAL}""")
    locate(p, f"{p}_q", rw)
    view(f"{p}_i", f"""SELECT *, {SIGNED} AS signed, {SIGNED} OR {LITERAL} AS literal_only, {REPEAT} AS rep, {TEXTUAL} AS textual FROM {findings}""")
    view(f"{p}_m1", f"""SELECT m.fid, m.case_exact, m.literal_exact, m.place, m.xmin AS mx0, m.ymin AS my0, m.xmax AS mx1, m.ymax AS my1, m.source AS msrc, m.text_start AS ms, m.text_end AS me,
      i.signed, i.literal_only, i.rep, i.text_start, i.box_source, i.xmin, i.ymin, i.xmax, i.ymax, bool_or(m.case_exact) OVER (PARTITION BY m.fid) AS any_case
      FROM {p}_p m JOIN {p}_i i ON i.uid = m.fid WHERE NOT literal_only OR literal_exact""")
    view(f"{p}_m2", f"""SELECT *, bool_or(literal_exact) OVER (PARTITION BY fid) AS any_lit FROM {p}_m1 WHERE case_exact OR NOT (any_case OR literal_only)""")
    view(f"{p}_m3", f"""SELECT *, count(*) OVER (PARTITION BY fid) AS n, text_start IS NULL AND xmin IS NOT NULL AND box_source <> 'unverified' AND (NOT signed OR (xmax - xmin) * (ymax - ymin) < 100000) AS hinted,
      sqrt(pow((mx0 + mx1) / 2 - (xmin + xmax) / 2, 2) + pow((my0 + my1) / 2 - (ymin + ymax) / 2, 2)) AS dist FROM {p}_m2 WHERE literal_exact OR NOT any_lit""")
    view(f"{p}_m4", f"""SELECT *, row_number() OVER (PARTITION BY fid ORDER BY CASE WHEN text_start IS NOT NULL AND ms <> text_start THEN 1 ELSE 0 END, CASE WHEN hinted THEN round(dist, 9) ELSE 0 END, place) AS rn FROM {p}_m3""")
    view(f"{p}_b", f"""SELECT *, CASE WHEN text_start IS NOT NULL THEN ms = text_start ELSE (hinted AND NOT signed) OR (NOT hinted AND (n = 1 OR rep)) OR (hinted AND signed AND n = 1) END AS found FROM {p}_m4 WHERE rn = 1""")
    view(f"{p}_gr", f"""SELECT i.* REPLACE (CASE WHEN found THEN mx0 ELSE i.xmin END AS xmin, CASE WHEN found THEN my0 ELSE i.ymin END AS ymin, CASE WHEN found THEN mx1 ELSE i.xmax END AS xmax,
      CASE WHEN found THEN my1 ELSE i.ymax END AS ymax, CASE WHEN found THEN msrc WHEN textual AND (NOT {MEASURED.replace('box_source', 'i.box_source')} OR (b.fid IS NOT NULL AND i.text_start IS NULL)) THEN 'unverified' ELSE i.box_source END AS box_source,
      CASE WHEN found THEN ms ELSE i.text_start END AS text_start, CASE WHEN found THEN me ELSE i.text_end END AS text_end), coalesce(found, false) AS found
      FROM {p}_i i LEFT JOIN {p}_b b ON b.fid = i.uid""")
    view(f"{p}_cp", f"""SELECT * FROM (SELECT g.uid AS fid, g.book_id, g.page_number, g.type, g.quote, g.suggestion, m.mx0, m.my0, m.mx1, m.my1, m.msrc, m.ms, m.me,
        row_number() OVER (PARTITION BY g.book_id, g.page_number, g.type, g.quote, g.suggestion, m.ms, m.mx0, m.my0 ORDER BY g.seq, g.uid) AS rn
      FROM {p}_gr g JOIN {p}_m3 m ON m.fid = g.uid AND m.case_exact AND m.literal_exact WHERE g.found AND g.rep AND NOT (m.mx0 = g.xmin AND m.my0 = g.ymin)) c
      WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {p}_gr o WHERE o.book_id = c.book_id AND o.page_number = c.page_number AND o.type = c.type AND o.quote = c.quote AND o.suggestion = c.suggestion
        AND (o.text_start = c.ms OR (o.box_source = c.msrc AND abs(o.xmin - c.mx0) < 1 AND abs(o.ymin - c.my0) < 1)))""")
    view(f"{p}_out", f"""SELECT uid, book_id, page_number, type, quote, suggestion, xmin, ymin, xmax, ymax, box_source, text_start, text_end, status FROM {p}_gr
      UNION ALL SELECT sha256(concat_ws('|', fid, CAST(ms AS VARCHAR), CAST(round(mx0, 3) AS VARCHAR), CAST(round(my0, 3) AS VARCHAR))), book_id, page_number, type, quote, suggestion, mx0, my0, mx1, my1, msrc, ms, me, 'open' FROM {p}_cp""")


view("exercise_findings_v", " UNION ALL ".join(f"SELECT {', '.join(seeds.exercise_finding_columns(*f))} FROM pages_v WHERE {seeds.EXERCISE_PAGES}" for f in seeds.EXERCISE_FINDINGS))
# A signed number takes the labels that the letter exercise proves wrong; each label after the first is a finding of its own.
view("proved_v", f"""SELECT f.uid AS puid, d.xmin AS px0, d.ymin AS py0, d.xmax AS px1, d.ymax AS py1, d.text_start AS ps, d.text_end AS pe, row_number() OVER (PARTITION BY f.uid ORDER BY d.xmin, d.text_start) AS turn
  FROM (SELECT * FROM findings_v UNION ALL BY NAME SELECT * FROM exercise_findings_v) f JOIN d8_v d ON d.book_id = f.book_id AND d.page_number = f.page_number AND d.quote = f.quote
   AND replace(d.suggestion, '−', '-') = replace(f.suggestion, '−', '-') WHERE f.text_start IS NULL AND {SIGNED.replace('quote', 'f.quote')}""")
view("seeded_v", """SELECT f.* REPLACE (coalesce(px0, xmin) AS xmin, coalesce(py0, ymin) AS ymin, coalesce(px1, xmax) AS xmax, coalesce(py1, ymax) AS ymax, CASE WHEN puid IS NULL THEN box_source ELSE 'pdf_text' END AS box_source,
    coalesce(ps, text_start) AS text_start, coalesce(pe, text_end) AS text_end, CASE WHEN turn > 1 THEN sha256(concat_ws('|', uid, CAST(ps AS VARCHAR))) ELSE uid END AS uid, CASE WHEN turn > 1 THEN 'open' ELSE status END AS status)
  FROM (SELECT * FROM findings_v UNION ALL BY NAME SELECT * FROM exercise_findings_v) f LEFT JOIN proved_v ON puid = f.uid""")
ground("g9", "seeded_v", "nat")
ranked("nat10", "native10_v", "'pdf_text'", "nato")
view("native10_v", "SELECT * FROM words_v WHERE page_number % 10 <> 7")
ground("g10", "findings_v", "nat10")
view("base10_v", "SELECT book_id, page_number, max(text_end) + 1 AS base FROM native10_v GROUP BY ALL")
view("retry10_v", f"""SELECT f.* REPLACE (CASE WHEN f.box_source = 'ai' THEN 'ai' ELSE g.box_source END AS box_source) FROM findings_v f JOIN g10_gr g ON g.uid = f.uid
  WHERE {TEXTUAL.replace('quote', 'f.quote').replace('type', 'f.type')} AND len({tokens('f.quote')}) > 0 AND NOT {MEASURED.replace('box_source', 'g.box_source')}""")
view("shift10_v", """SELECT w.* REPLACE (text_start + coalesce(base, 1) AS text_start, text_end + coalesce(base, 1) AS text_end) FROM ocr_words_v w
  LEFT JOIN base10_v b ON b.book_id = w.book_id AND b.page_number = w.page_number""")
streams("ocro", "ocr_words_v", "concat(block_id, ':1')")
ranked("ocr10", "shift10_v", "'ocr_text'", "ocro")
ground("h10", "retry10_v", "ocr10")

view("typo_v", """SELECT concat('q', doc_id) AS fid, book_id, page_number, false AS allow_numeric, CASE WHEN doc_id % 2 = 0 THEN 'the part will Complte the figure'
  ELSE 'the part wil Complete the figure' END AS quote FROM pages_v WHERE doc_id % 5 = 0""")


def fuzzy(p, rw):
    sim = "CASE WHEN lower(q_cs) = lower(tok_cs) THEN 1.0::DOUBLE WHEN greatest(length(q_cs), length(tok_cs)) > 100 THEN 0 ELSE 1 - levenshtein(lower(q_cs), lower(tok_cs)) / greatest(length(q_cs), length(tok_cs)) END"
    return f"""SELECT fid, book_id, page_number, stream, start, first, last, case_exact, worst = 1 AS exact, score FROM (
      SELECT fid, book_id, page_number, stream, start, min(rank) AS first, max(rank) AS last, avg(sim) AS score, min(sim) AS worst, count(*) AS n, max(k) AS k, count(*) FILTER (WHERE q_cs = tok_cs) = max(k) AS case_exact FROM (
       SELECT fid, q.book_id, q.page_number, stream, k, q_cs, tok_cs, rank, pos - j AS start, {sim} AS sim FROM {p}_qt q JOIN {rw}_pt t ON t.book_id = q.book_id AND t.page_number = q.page_number
       WHERE k >= 2 AND least(length(q_cs), length(tok_cs)) >= greatest(length(q_cs), length(tok_cs)) * .8) WHERE sim >= .8
      GROUP BY fid, book_id, page_number, stream, start) WHERE n = k AND (worst = 1 OR score >= .9)"""


locate("ty", "typo_v", "nat", fuzzy("ty", "nat"))
# Review boxes: findings not already on recognised words, fuzzy search for two tokens or more.
view("rv_q", f"""SELECT uid AS fid, book_id, page_number, quote, false AS allow_numeric FROM findings_v WHERE length(trim(quote)) >= 2 AND NOT (box_source = 'ocr_text' AND xmin IS NOT NULL)""")
view("one_q", f"SELECT * FROM rv_q WHERE len({tokens('quote')}) = 1")
locate("rv", "rv_q", "nat", fuzzy("rv", "nat"))
locate("rs", "one_q", "nat")
view("rb1_v", f"""SELECT m.*, i.literal_only, i.hinted, i.cx, i.cy, bool_or(case_exact) OVER (PARTITION BY m.fid) AS any_case FROM (SELECT * FROM rv_p UNION ALL SELECT * FROM rs_p) m
  JOIN (SELECT uid, {LITERAL} AS literal_only, xmin IS NOT NULL AND box_source <> 'unverified' AS hinted, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM findings_v) i ON i.uid = m.fid
  WHERE NOT literal_only OR literal_exact""")
view("rb2_v", "SELECT *, bool_or(exact) OVER (PARTITION BY fid) AS any_exact FROM rb1_v WHERE case_exact OR NOT (any_case OR literal_only)")
view("rb3_v", """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fid) AS n, row_number() OVER (PARTITION BY fid ORDER BY CASE WHEN hinted THEN
  round(sqrt(pow((xmin + xmax) / 2 - cx, 2) + pow((ymin + ymax) / 2 - cy, 2)), 9) ELSE 0 END, place) AS rn FROM rb2_v WHERE exact OR NOT any_exact) WHERE rn = 1 AND (hinted OR n = 1)""")
view("d9_q", """SELECT DISTINCT book_id, page_number, concat_ws('|', book_id, CAST(page_number AS VARCHAR), '0') AS fid, 'Patterns Recognition' AS quote, false AS allow_numeric FROM words_v
  WHERE regexp_matches(str, '(?i)^Unit(?:[-:]?[0-9]+[:.]?)?$')""")
locate("d9", "d9_q", "nat")
view("d9_v", r"""SELECT book_id, page_number, CAST(90000000 + text_start AS BIGINT) AS seq, 'Patterns Recognition' AS quote, 'Pattern Recognition' AS suggestion,
  round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax, source AS box_source, text_start, text_end FROM d9_p m
  WHERE case_exact AND literal_exact AND EXISTS (SELECT 1 FROM words_v u WHERE u.book_id = m.book_id AND u.page_number = m.page_number AND regexp_matches(u.str, '(?i)^Unit(?:[-:]?\d+[:.]?)?$')
   AND abs(u.ymin - m.ymin) < 15 AND u.xmin < m.xmin)""")
R6 = ", ".join(f"round({b}, 6) AS {b}" for b in ("xmin", "ymin", "xmax", "ymax"))
GO = f"uid, book_id, page_number, type, quote, suggestion, {R6}, box_source, text_start, text_end, status"
D10 = "book_id, page_number, seq, rule_id, type, severity, quote, suggestion, xmin, ymin, xmax, ymax, box_source, text_start, text_end, confidence"

ORACLES = {
    "j6_continuous": compose("SELECT fid, CAST(start AS BIGINT) AS start, literal_exact, continuous FROM lq_c"),
    "j7_locate_phrases": compose(f"SELECT fid, case_exact, literal_exact, {R6}, text_start, text_end, CAST(place AS INT) AS place FROM lq_p"),
    "j5_reading_streams": compose("SELECT book_id, page_number, CAST(stream AS INT) AS stream, CAST(ord AS INT) AS ord, CAST(word_idx AS INT) AS word_idx FROM ocro_st_mat"),
    "j7_locate_phrases_all_orders": compose(f"SELECT fid, case_exact, literal_exact, {R6}, text_start, text_end, CAST(place AS INT) AS place FROM la_p"),
    "j8_fuzzy_locate": compose(f"SELECT fid, exact, round(score, 6) AS score, {R6}, text_start, text_end, CAST(place AS INT) AS place FROM ty_p"),
    "j9_ground_findings": compose(f"SELECT {GO} FROM g9_out"),
    "j10_ground_with_fallback": compose(f"""SELECT {GO} FROM (SELECT g.* FROM g10_out g ANTI JOIN retry10_v r ON r.uid = g.uid UNION ALL SELECT * FROM h10_out)"""),
    "j11_locate_review_boxes": compose(f"""SELECT f.uid, round(CASE WHEN found THEN m.xmin WHEN keep THEN f.xmin END, 6) AS xmin, round(CASE WHEN found THEN m.ymin WHEN keep THEN f.ymin END, 6) AS ymin,
      round(CASE WHEN found THEN m.xmax WHEN keep THEN f.xmax END, 6) AS xmax, round(CASE WHEN found THEN m.ymax WHEN keep THEN f.ymax END, 6) AS ymax,
      CASE WHEN found THEN 'pdf_text' WHEN keep THEN f.box_source ELSE 'unverified' END AS box_source FROM (SELECT i.*, m.fid IS NOT NULL AS found,
       m.fid IS NULL AND ((i.box_source = 'ocr_text' AND i.xmin IS NOT NULL) OR (((type IN ('image','alignment','layout','spacing','overflow','typography') AND i.box_source <> 'unverified' AND NOT (type = 'typography' AND us))
         OR {MEASURED.replace('box_source', 'i.box_source')}) AND NOT (us AND {LITERAL}))) AS keep FROM (SELECT *, length(trim(quote)) >= 2 AS us FROM findings_v) i LEFT JOIN rb3_v m ON m.fid = i.uid) f
      LEFT JOIN rb3_v m ON m.fid = f.uid"""),
    "d9_unit_label": compose("SELECT * FROM d9_v"),
    "d10_lint_pages": compose(f"""SELECT {D10} FROM lint_text_v UNION ALL SELECT book_id, page_number, seq, 'lowercase_heading', type, severity, quote, suggestion, xmin, ymin, xmax, ymax, box_source, text_start, text_end, confidence FROM d7_v
      UNION ALL SELECT book_id, page_number, seq, 'letter_steps', type, severity, quote, suggestion, xmin, ymin, xmax, ymax, box_source, text_start, text_end, confidence FROM d8_v
      UNION ALL SELECT book_id, page_number, seq, 'unit_label', 'wording', 'minor', quote, suggestion, xmin, ymin, xmax, ymax, box_source, text_start, text_end, 0.98::DOUBLE FROM d9_v"""),
}
