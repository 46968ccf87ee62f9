"""Mixing, secret scan, line dedup and quality rules against plain Python over odd rows."""
import collections
import hashlib
import random
import re

from foliocheck.llm import line_dedup, mixing, quality_rules, secret_scan
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_mix_meets_targets(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(cases.odd_rows())
    total = sum(r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        by[r.source].append(r)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6
    for source, group in by.items():
        own = sum(r["size"] for r in group)
        assert {r.source_size for r in group} == {own} and group[0].target <= 3 * own + 1e-9
        assert abs(sum(r.taken for r in group) - group[0].target) <= 2 * max(r["size"] for r in group)


def test_targets_fill_like_a_loop(spark):
    sizes = [10, 1000, 3, 0, 500, 40]
    table = spark.createDataFrame([(False, f"s{i}", n) for i, n in enumerate(sizes)], "no_source boolean, src string, source_size long")
    got = {r.src: r.target for r in mixing.targets(table).collect()}
    weight = {f"s{i}": (5, 2, 1)[i % 3] for i in range(len(sizes))}
    cap = {f"s{i}": 3 * n for i, n in enumerate(sizes)}
    full, want = set(), {}
    while True:
        rest = sum(sizes) - sum(cap[s] for s in full)
        open_weight = sum(w for s, w in weight.items() if s not in full)
        want = {s: cap[s] if s in full else rest * w / open_weight for s, w in weight.items()}
        over = {s for s in want if want[s] > cap[s] + 1e-12}
        if not over:
            break
        full |= over
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_mix_reruns_agree_and_empty(odd, empty):
    one, two = (sorted((r.doc_id or -1, r["size"], r.taken) for r in mixing.mix(odd.repartition(n)).collect()) for n in (1, 5))
    assert one == two
    assert mixing.mix(empty).collect() == []


def test_line_dedup(odd, empty):
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.dedup_lines(odd).collect())
    rows, own = cases.odd_rows(), collections.defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            own[key(line)].add(-1 if doc is None else doc)
    want = collections.Counter()
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(own[key(x)]) >= 5 and max(own[key(x)]) != (-1 if doc is None else doc))]
        want[doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert got == want and any(k[2] for k in got)
    assert line_dedup.dedup_lines(empty).collect() == []


def test_quality_ledger(spark, odd, empty):
    judged = quality_rules.apply_policy(quality_rules.ledger(odd))
    for r in judged.collect():
        text = r.text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        triples = list(zip(words, words[1:], words[2:]))
        count, covered = collections.Counter(triples), set()
        for i, t in enumerate(triples):
            if count[t] > 1:
                covered |= {i, i + 1, i + 2}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)), r.doc_id
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.kept and r.base_failed)
    report = {(r.policy, r.rule): r for r in quality_rules.ablation(spark, quality_rules.ledger(odd)).collect()}
    bits = [r.failed_bits for r in judged.collect()]
    assert report["v1", "too_few_words"].n_failed == sum(b & 1 for b in bits)
    assert report["v3", "too_few_words"].n_only == sum(b == 1 for b in bits)
    assert quality_rules.apply_policy(quality_rules.ledger(empty)).collect() == []


BASE = {"assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(r"[0-9a-f]+"), 0, 32)}


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    order = list(BASE)
    return sorted((m.start(), order.index(k), k, m.end()) for k, (p, g, least) in BASE.items() for m in p.finditer(text) if len(m.group(g)) >= least)


def test_secret_spans_and_links(spark, odd, empty):
    texts = ["token = abcdefgh1 Password:'short' SECRET=\"x\" api_key=AKIA" + "Q" * 12, "é\U0001f600 token=secret:abcdefghijk token==" + "f" * 40,
             "AKIA AKIAABC " + "0123456789abcdef" * 2 + " " + "a" * 31, "login=joe password=tiny1 " + "w " * 300 + "password=tiny2",
             "user: ann key https://db.example.org:5432 secret='abcd'", "token='12345678' " * 500 + "AKIA" + "Z" * 8]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secret_scan.scan(docs).select("*", secret_scan.written("secrets", secret_scan.BASE).alias("base"), secret_scan.written("secrets").alias("all")).collect():
        want = base_spans(r.text)
        assert r.base == ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in want) for k in BASE)
        if r.doc_id == 3:
            assert "weak_assign:10:24" in r.all and r.all.count("weak_assign") == 1       # the second has no identifier within its scope
        if r.doc_id == 4:
            assert all(k in r.all for k in ("weak_login", "endpoint", "weak_assign"))
        if r.doc_id == 5:
            assert "weak_access" in r.all
    cleaned = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert "abcdefgh1" not in cleaned[0] and "tiny2" in cleaned[3] and cleaned[2].startswith("AKIA AKIAABC [SECRET]")
    assert all(not r.secrets for r in secret_scan.scan(odd).collect()) and secret_scan.scan(odd).count() == len(cases.odd_rows())
    assert secret_scan.scan(empty).collect() == []


def test_secret_parts_link_at_their_ends_however_long(spark):
    key, far = "k9" * 500, " " * 199
    texts = [f"token = {key}\nuser: bob", f"user: bob\ntoken = {key}", f"token = {key}{far} user: bob", f"token = {key}{far}  user: bob",
             f"https://{'x' * 1000}.org password=tiny1", f"user: {'z' * 1000} password=tiny1", f"password=tiny1{far} user: {'z' * 1000}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.secrets] for r in secret_scan.scan(docs).collect()}
    assert got == {0: ["assign", "weak_login"], 1: ["weak_login", "assign"], 2: ["assign", "weak_login"], 3: ["assign"],
                   4: ["weak_assign"], 5: ["weak_login", "weak_assign"], 6: ["weak_assign", "weak_login"]}


def test_secret_links_equal_brute_force_on_distance(spark):
    rng, rows = random.Random(8), []
    for doc in range(60):
        for _ in range(rng.randint(2, 7)):
            start = rng.randrange(3000)
            rows.append((doc, 0, "k", rng.choice(["identifier", "secret", "endpoint"]), start, start + rng.choice([1, 5, 30, 200, 201, 700, 1500]), rng.random() < 0.3))
    rows = list({r[:6]: r for r in rows}.values())
    def near(w, role):
        return any(q[0] == w[0] and q[3] == role != w[3] and q[4] <= w[5] + 200 and q[5] >= w[4] - 200 for q in rows)
    def reported(w):
        identifier, secret, endpoint = (near(w, r) for r in ("identifier", "secret", "endpoint"))
        return w[6] or {"identifier": secret, "secret": identifier or endpoint, "endpoint": identifier and secret}[w[3]]
    found = spark.createDataFrame(rows, "doc_id long, text_hash long, kind string, role string, start long, end long, strong boolean")
    got = sorted((r.doc_id, r.start, r.end) for r in secret_scan.link(found).collect())
    assert got == sorted((w[0], w[4], w[5]) for w in rows if reported(w)) and len(got) < len(rows)


def test_texts_are_searched_once(spark):
    """No filter repeats the patterns, the result reads written parts, and no text moves that it does not keep."""
    docs = cases.frame(spark, [(1, 'password = "abcdefgh12" login: bob http://x.example', "en", "a", 9), (2, "AKIA1234567890ABCD " + "0a" * 20, "en", "a", 9), (3, None, "en", "a", 0)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    searched = [line for line in plan(secret_scan.parts(docs)) if "AKIA" in line]
    assert len(searched) == 1 and "Filter" not in searched[0]
    found = secret_scan.scan(docs).select("doc_id", "secrets")
    assert not any("AKIA" in line for line in plan(found)) and not any("Join" in line and "text#" in line for line in plan(found))
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in found.collect()} == {
        1: [("assign", 0, 22), ("weak_login", 24, 34), ("endpoint", 35, 51)], 2: [("access", 0, 18), ("hex", 19, 59)], 3: []}
    for part in secret_scan.PARTS:
        assert not part.holds or not re.search(part.pattern, "password secret AKI user login https// " + "".join(chr(c) for c in range(32, 127) if chr(c) not in ":="))
