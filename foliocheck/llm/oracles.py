"""DuckDB SQL for the rows of those queries that SQL can express, over the same tables."""
from __future__ import annotations

from foliocheck.llm import collocations, mixing, ngram_join, quality_rules, secret_scan, sharding

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _mix() -> str:
    weights = ", ".join(f"{w}.0::double" for w in mixing.WEIGHTS)
    epochs = mixing.MAX_EPOCHS
    return rf"""
WITH d AS (SELECT doc_id, source IS NULL AS ns, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint AS size,
                  md5('{mixing.SEED}:' || doc_id) AS turn FROM documents),
s AS (SELECT ns, src, sum(size)::bigint AS source_size FROM d GROUP BY 1, 2),
w AS (SELECT *, ([{weights}])[((row_number() OVER (ORDER BY ns, src) - 1) % {len(mixing.WEIGHTS)}) + 1] AS weight, source_size * {epochs}.0::double AS cap FROM s),
f AS (SELECT *, cap / weight AS fill, (SELECT sum(source_size) FROM s)::double AS total, (SELECT sum(weight) FROM w) AS all_weight FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (all_weight - coalesce(sum(weight) OVER o, 0)) AS level FROM f
      WINDOW o AS (ORDER BY fill, ns, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT ns, src, source_size, least(cap, weight * (SELECT max(level) FROM l WHERE level <= fill)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.ns, d.src ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
      FROM d JOIN t ON d.ns = t.ns AND d.src = t.src),
c AS (SELECT r.*, (e.epoch * source_size + sent) / target AS finish FROM r, (SELECT unnest(range({epochs})) AS epoch) e WHERE size > 0 AND target > 0),
k AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, ns, src, sent ROWS UNBOUNDED PRECEDING) AS into_mix FROM c),
g AS (SELECT doc_id, sum(size) AS taken FROM k WHERE into_mix <= (SELECT sum(size) FROM d) GROUP BY 1)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(g.taken, 0)::bigint AS taken FROM r LEFT JOIN g ON r.doc_id = g.doc_id"""


def _ngrams() -> str:
    n = ngram_join.SIZE
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= {n} THEN list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i:i + {n - 1}], ' '))
                                     WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_have >= 75 * (nx.n + ny.n - both_have)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT w.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) c ON c.x = w.doc_id"""


def _secrets() -> str:
    scope = secret_scan.SCOPE
    each = []
    for part in secret_scan.PARTS:
        pattern = part.pattern.replace("'", "''")
        strong = f"value_len >= {part.strong}" if part.strong else "false"
        each.append(f"""SELECT doc_id, '{part.kind}' AS base, '{part.role}' AS role, '{part.weak_kind}' AS weak_kind, k, found[k] AS m, {strong} AS strong, value_len >= {part.weak} AS weak,
  (list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda f: length(f))), 0))::bigint AS s
FROM (SELECT *, length(vals[k]) AS value_len FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (
  SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {part.group}) AS vals, string_split_regex(text, '{pattern}') AS gaps FROM d)))""")
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secret_scan.KINDS)) + " END"
    def near(role: str) -> str:
        return (f"EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.role = '{role}' AND q.role <> p.role AND abs(q.s // {scope} - p.s // {scope}) <= 1 "
                f"AND q.s <= p.t + {scope} AND q.t >= p.s - {scope})")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(each)}),
p AS (SELECT doc_id, CASE WHEN strong THEN base ELSE weak_kind END AS kind, role, strong, s, s + length(m) AS t FROM m WHERE strong OR weak),
r AS (SELECT doc_id, kind, s, t, {order} AS o FROM p WHERE strong OR CASE role WHEN 'identifier' THEN {near('secret')}
        WHEN 'secret' THEN {near('identifier')} OR {near('endpoint')} ELSE {near('identifier')} AND {near('secret')} END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || t, ',' ORDER BY s, o, t) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
             string_agg(kind || ':' || s || ':' || t, ',' ORDER BY s, o, t) AS spans FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


_EXACT = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))"""

_LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
h AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING n >= 5),
j AS (SELECT k.*, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS gone FROM k LEFT JOIN h ON h.key = k.key)
SELECT doc_id, count(*)::bigint AS n_lines, (count(*) FILTER (gone))::bigint AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1"""


def _quality() -> str:
    measures = "n_words, word_chars, n_symbols, n_dup_lines, n_text_lines, n_repeat_words"
    failed = " OR ".join(f"({rule})" for i, (_, rule) in enumerate(quality_rules.RULES) if quality_rules.CURRENT.mask >> i & 1)
    base = " OR ".join(f"({rule})" for i, (_, rule) in enumerate(quality_rules.RULES) if quality_rules.BASE_MASK >> i & 1)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS t FROM d WHERE len(w) >= 3),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '{_WORD}') GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint AS n_symbols,
             coalesce(l.dups, 0)::bigint AS n_dup_lines, coalesce(l.n, 0)::bigint AS n_text_lines, coalesce(c.n, 0)::bigint AS n_repeat_words
      FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id)
SELECT doc_id, {measures.replace("n_text_lines, ", "")}, ({base}) AS base_failed, NOT ({base} OR {failed}) AS kept FROM m"""


def _shards() -> str:
    def tree(nodes: list[sharding.Shard]) -> str:
        return ", ".join(f"('{s.region}', '{s.region}/{s.rack}', '{s.region}/{s.rack}/{s.shard}', {s.shard}, {s.weight}::double)" for s in nodes)
    def drawn(node: str) -> str:
        return f"(('0x' || md5('{sharding.SEED}:' || {node} || ':' || k)[1:13])::bigint + 0.5) / 4503599627370496.0"
    def level(parent: str, child: str) -> str:
        # The winner among the children of the node that the level before chose.
        return f"""(SELECT doc_id, k, grown, arg_max(node, (ln({drawn("node")}) / w, node)) AS node FROM
  (SELECT p.doc_id, p.k, p.grown, c.node, c.w FROM {parent} JOIN (SELECT grown, {child.split(",")[0]} AS up, {child.split(",")[1]} AS node, sum(w) AS w FROM tree GROUP BY ALL) c ON c.grown = p.grown AND c.up = p.node)
  GROUP BY ALL)"""
    regions = level("(SELECT doc_id, k, grown, '' AS node FROM d, (SELECT unnest([false, true]) AS grown)) p", "'',region")
    racks = level(f"{regions} p", "region,rack")
    shards = level(f"{racks} p", "rack,leaf")
    return f"""
WITH tree AS (SELECT * REPLACE (grown = 1 AS grown) FROM (SELECT 0 AS grown, * FROM (VALUES {tree(sharding.layout())}) v(region, rack, leaf, shard, w)
              UNION ALL SELECT 1, * FROM (VALUES {tree(sharding.grow(sharding.layout()))}) v(region, rack, leaf, shard, w))),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT doc_id, grown, shard FROM {shards} p JOIN tree USING (grown) WHERE leaf = node),
m AS (SELECT d.*, octet_length(encode(text)) + 1 AS size, {drawn("'slot'")} AS turn,
             xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::bigint)),
                                         lambda x, b: xor(x >> 8, ({_byte_steps()}::bigint[])[(xor(x, b) & 255) + 1]))) AS text_crc32 FROM d)
SELECT m.doc_id, m.size::bigint AS size, m.text_crc32::bigint AS text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY turn, m.doc_id) - 1 AS slot, b.shard AS grown_shard
FROM m JOIN s a ON a.doc_id = m.doc_id AND NOT a.grown JOIN s b ON b.doc_id = m.doc_id AND b.grown"""


def _byte_steps() -> list[int]:
    """What each byte adds to a CRC-32, by its rule: eight shifts, each followed by the polynomial where a one falls out."""
    steps = list(range(256))
    for _ in range(8):
        steps = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in steps]
    return steps


def _phrases() -> str:
    least, most, top = collocations.MIN_COUNT, collocations.MAX_WORDS, collocations.TOP
    return rf"""
WITH p AS (SELECT lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?
-
]')) AS piece FROM (SELECT text, coalesce(lang, 'und') AS lang FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM o, (SELECT unnest(range(1, {most + 1})) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, count(*)::hugeint AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
n AS (SELECT lang, sum(len(w))::hugeint AS n FROM w GROUP BY 1),
c AS (SELECT * FROM f WHERE k >= 2),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, cut, 1000 * c.f * n.n // (l.f * r.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN n ON n.lang = c.lang
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (SELECT DISTINCT lang, array_to_string(words[i:i + j - 1], ' ') AS phrase, f FROM (SELECT *, unnest(range(1, k)) AS i FROM c), (SELECT unnest(range(2, {most})) AS j)
          WHERE j < k AND i + j - 1 <= k),
open AS (SELECT * FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM inner_parts s WHERE s.lang = x.lang AND s.phrase = x.phrase AND 100 * s.f >= 100 * x.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n::bigint AS n, score::bigint AS score
FROM open QUALIFY rank <= {top}"""


ORACLES: dict[str, str] = {
    "op1_mix_sources": _mix(),
    "op2_ngram_join": _ngrams(),
    "op3_secret_scan": _secrets(),
    "op6_exact_dedup": _EXACT,
    "op8_line_dedup": _LINES,
    "op10_quality_rules": _quality(),
    "op11_sharding": _shards(),
    "op13_collocations": _phrases(),
}
