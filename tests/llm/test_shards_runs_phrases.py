"""Shards, periodic runs and collocations against plain Python."""
import collections
import hashlib
import math
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliocheck.llm import collocations, periodic, queries, sharding
from foliocheck.llm.sharding import Shard
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def descend(key: str, tree) -> int:
    nodes, path = sharding.children(tree), ""
    for _ in range(3):
        path = max((math.log((int(hashlib.md5(f"shards:{c}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52) / w, c) for c, w in nodes[path].items())[1]
    return int(path.rsplit("/", 1)[1])


def test_shards_equal_brute_force(odd, empty):
    got, want = sharding.assign(odd).collect(), cases.odd_rows()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(r[:2] for r in want)
    slots = collections.defaultdict(list)
    for r in got:
        body = (r.text or "").encode()
        key = str(r.doc_id) if r.doc_id is not None else "text:" + hashlib.md5(body).hexdigest()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "key") and r.score == "mine"
        assert r.shard == descend(key, sharding.layout()) and r.grown_shard == descend(key, sharding.grow(sharding.layout())) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign(empty).collect() == []


def test_slots_do_not_depend_on_partitions_and_part_a_hot_id(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 900).alias("text"))
    runs = [sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.assign(docs.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    by = collections.defaultdict(set)
    for *_, shard, slot in runs[0]:
        by[shard].add(slot)
    assert sum(map(len, by.values())) == 3000 and all(v == set(range(len(v))) for v in by.values())


def test_movement_stays_in_the_subtrees_whose_weights_changed(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))

    def shares(*trees):
        return keys.select(*[sharding.shard_of(F.col("k"), t).alias(f"t{i}") for i, t in enumerate(trees)]).collect()
    tree = sharding.layout()
    for a, b in shares(tree, sharding.grow(tree)):
        assert b in (a, 8)
    heavier = [s._replace(weight=3.0) if s.shard == 0 else s._replace(weight=0.0) if s.shard == 1 else s for s in tree]     # rack k0: 2 -> 3, region r0: 4 -> 5
    for a, b in shares(tree, heavier):
        assert a == b or b < 4 and (a >= 4 or a == 1 or b < 2)
    traded = [s._replace(weight=0.5) if s.shard == 4 else s._replace(weight=1.5) if s.shard == 5 else s for s in tree]      # inside one rack
    assert all(a == b or (a, b) == (4, 5) for a, b in shares(tree, traded))
    weighted = [Shard("x", "a", 0, 1), Shard("x", "a", 1, 2), Shard("x", "b", 2, 3), Shard("y", "c", 3, 4)]
    count = collections.Counter(r[0] for r in shares(weighted))
    assert all(abs(count[i] / 20000 - (i + 1) / 10) < 0.015 for i in range(4))
    with pytest.raises(ValueError):
        sharding.children([Shard("x", "a", 0, 0.0)])


def test_shard_folders_hold_every_row(spark, odd):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/shards"
    sharding.write_shards(spark, odd.select("doc_id", "text"), path)
    back = spark.read.parquet(path)
    want = {(r.doc_id, r.text, r.shard) for r in sharding.assign(odd).collect()}
    assert {(r.doc_id, r.text, r.shard) for r in back.collect()} == want and back.count() == len(cases.odd_rows())


def brute_runs(w: list, least: int = 6, exponent: int = 4) -> list[tuple]:
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(w[i:i + length - d] == w[i + d:i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_collapsed(w: list, runs: list[tuple]) -> str:
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_in_arrays_equal_brute_force():
    rng, total = random.Random(4), 0
    for least, exponent in ((6, 4), (6, 4), (3, 3), (11, 5)):
        for _ in range(150):
            docs = []
            for _ in range(rng.randint(1, 4)):
                letters, w = rng.randint(1, 4), []
                for _ in range(rng.randint(0, 20)):
                    unit = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
                    w += unit * rng.choice([1, 1, 4, 6]) + unit[:rng.randint(0, len(unit))]
                docs.append(w)
            starts = np.cumsum([0] + [len(d) for d in docs]).tolist()
            want = [(s + o, length, q) for d, o in zip(docs, starts) for s, length, q in brute_runs(d, least, exponent)]
            flat, doc = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            assert [tuple(r) for r in periodic.find_runs(flat, doc, least, exponent).tolist()] == sorted(want)
            total += len(want)
    assert total > 1000


def test_one_long_run_is_one_extension():
    for period in (1, 3, 1000):
        words = np.arange(300_000) % period
        assert periodic.find_runs(words, np.zeros(len(words), np.int64)).tolist() == [[0, 300_000, period]]


def test_collapse_over_odd_rows(spark, odd, empty, monkeypatch):
    texts = ["la " * 20, "a b c " * 5 + "x", " \n ", "no run at all here", "x\ty\x0bx y x y x y z z z z z z"]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(900 + i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, score string"))
    for r in periodic.collapse(docs).collect():
        words = WORD.findall(r.text or "")
        runs = brute_runs(words) if len(words) < 2000 else [tuple(x) for x in r.runs]
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == brute_collapsed(words, runs) and r.score == "mine"
    assert periodic.collapse(empty).collect() == []
    monkeypatch.setattr(periodic, "SLICE_BYTES", 10)
    import pyarrow as pa
    cut = [list(periodic._slices(np.array(x))) for x in ([], [3, 50, 2, 2, 2], [50])]
    assert cut == [[], [(0, 1), (1, 2), (2, 5)], [(0, 1)]]
    listed, collapsed = periodic._search(pa.array([None, "", "a " * 9]))
    assert listed.to_pylist() == [[], [], [{"start": 0, "length": 9, "period": 1}]] and collapsed.to_pylist() == ["", "", "a"]


def test_registered_runs_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    seen = 0
    for r in queries.op12_periodic_runs(spark, sf).collect():
        w, h = WORD.findall(texts[r.doc_id] or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if len(w) > 3000:
            continue
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5


def brute_phrases(rows: list[tuple], least: int, most: int, top: int) -> list[tuple]:
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        longer = [(lang, *x) for (m, *x), c in f.items() if m == lang and len(x) > len(w) and c >= a and c >= least and any(x[i:i + len(w)] == w for i in range(len(x)))]
        if not longer:
            score, _, l, r = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("least,most,top", [(3, 5, 2000), (2, 3, 4), (6, 2, 50)])
def test_phrases_equal_brute_force(spark, least, most, top):
    rng = random.Random(9)
    vocabulary = ["the", "The", "new", "york", "ñu", "\U0001f600", "x=1", "of", "a", "don't"]
    rows = [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "...", " ! "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (" ,. \t", "fr"), ("new york new york new york new york", "en"), ("in the new york of a", "en")]
    docs = spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, score int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, most, top, block_bytes=500, lane=20).collect())
    assert got == brute_phrases(rows, least, most, top) and len(got) > 5


def test_phrases_over_odd_rows(spark, odd, empty):
    got = sorted(tuple(r) for r in collocations.collocations(odd, 4, 3, 100).collect())
    assert got == brute_phrases([(r[1], r[2]) for r in cases.odd_rows()], 4, 3, 100)
    assert collocations.collocations(empty).collect() == [] and collocations.collocations(odd, 10 ** 6).collect() == []


def test_scores_past_64_bits_are_exact(spark):
    from pyspark.sql import Row
    a, n = 3_000_000_000_000, 9_000_000_000_000_000
    levels = [spark.createDataFrame([Row(gid=1, lang="en", phrase="x y", f=a, heads=[a + 7, a], tails=[a + 11, a], a=1, b=2)]).select("*")] * 1
    sizes = spark.createDataFrame([("en", n)], "lang string, n long")
    real = collocations.frequent_phrases
    collocations.frequent_phrases = lambda *_: (sizes, [None, *levels])
    try:
        row = collocations.collocations(sizes).first()
    finally:
        collocations.frequent_phrases = real
    assert row.score == 1000 * a * n // ((a + 7) * (a + 11))
