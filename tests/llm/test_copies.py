"""Exact dedup and the n-gram join against brute force."""
import collections
import hashlib
import random
import re

import pytest

from foliocheck.llm import exact_dedup, ngram_join
from foliocheck.llm.components import components
from foliocheck.llm.trie_join import join_block
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(sets):
    up = list(range(len(sets)))
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def near_copies(n_groups=12, seed=5):
    rng, texts = random.Random(seed), []
    for g in range(n_groups):
        words = cases.prose(1000 + g, rng.choice([4, 8, 40, 90])).split()
        for _ in range(rng.randint(1, 9)):
            copy = words[:]
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10_000)}"
            texts.append(" ".join(copy[:rng.randint(max(3, len(copy) - 6), len(copy))]))
    return texts


def test_trie_join_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        base = [sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(4)]
        sets = [sorted(set(rng.choice(base)) ^ set(rng.sample(range(60), rng.randint(0, 5)))) for _ in range(30)]
        assert join_block(sets) == brute([frozenset(s) for s in sets])
    assert join_block([[1], [9], []], [0, 0, 1]) == [0, 0, 2]


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 150])
def test_ngram_join_equals_brute_force(spark, block):
    texts = near_copies() + [None, "", " \n ", "only four words here", "Only FOUR words here"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(cases.frame(spark, rows).repartition(4), block).collect()}
    sets = [shingles(t) for t in texts]
    assert got == {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, brute(sets)))}
    assert len({r for _, r in got.values()}) < len(texts)


def test_hot_tokens_build_salted_stars(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 2)
    monkeypatch.setattr(ngram_join, "HOT_TIMES", 0)
    texts = near_copies(6, 9)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(cases.frame(spark, rows)).collect()}
    assert got == dict(enumerate(brute([shingles(t) for t in texts])))


def test_a_shared_passage_ties_no_sets_together(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MANY", 2)
    passage = cases.prose(1, 30)
    texts = [f"{cases.prose(50 + i // 2, 40)} {passage} end {i}" for i in range(24)] + near_copies(4, 3)
    sets = [shingles(t) for t in texts]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
    frame = spark.createDataFrame([(i, len(s), sorted(numbers[t] for t in s)) for i, s in enumerate(sets) if i < 24], "s1 long, n long, set array<long>")
    assert {r.s1: r.comp for r in ngram_join._cut_by_sets(frame).collect()} == {i: i - i % 2 for i in range(24)}
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (5, "id of another text", "en", "s", 1)]
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(cases.frame(spark, rows)).filter("n_shingles <> 1").collect()}
    assert got == {i: r for i, r in enumerate(brute(sets)) if len(sets[i]) != 1}


def test_ngram_join_odd_rows(odd, empty):
    rows = ngram_join.link_documents(odd).collect()
    assert len(rows) == len(cases.odd_rows())
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.component_id)
    assert by[1] == by[5] == {1} and by[6] == by[7] == {6} and by[3] == {3} and by[4] == {4} and len(by[11]) == 1
    assert ngram_join.link_documents(empty).collect() == [] and ngram_join.dedup(empty).collect() == []
    kept = [r.doc_id for r in ngram_join.dedup(odd).collect()]
    assert 5 not in kept and 7 not in kept and {1, 2, 3, 4, 6, 40, 43}.issubset(kept) and not {41, 42} & set(kept)


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("z", "z"), ("y", "x")]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(61)}, "x": "x", "y": "x"}


def test_exact_dedup(odd, empty):
    rows = exact_dedup.members(odd, exact_dedup.build_index(odd, capacity=4)).collect()
    groups = collections.defaultdict(list)
    for doc, text, *_ in cases.odd_rows():
        groups[text or ""].append(doc)
    want = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want
    assert {r.doc_id for r in exact_dedup.dedup(odd).collect()} == {k[0] for k in want if k[3]}
    assert exact_dedup.members(empty, exact_dedup.build_index(empty)).collect() == []


def test_dedups_keep_one_row_of_each_group(spark):
    rows = cases.odd_rows() + cases.odd_rows()[3:] + [(5, "another text that shares its id with a near copy", "en", "a", 3)] * 2 + [(90, "Alpha beta gamma delta epsilon zeta", "en", "a", 35)]
    docs = cases.frame(spark, rows).repartition(3)
    order = lambda pairs: sorted(pairs, key=repr)
    groups = collections.defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    want = [(max((i for i in ids if i is not None), default=None), text) for text, ids in groups.items()]
    assert order((r.doc_id, r.text or "") for r in exact_dedup.dedup(docs).collect()) == order(want)
    distinct = order({(doc, text or "") for doc, text, *_ in rows})
    root = brute([shingles(text) for _, text in distinct])
    least = {}
    for (doc, text), r in zip(distinct, root):
        if doc is not None and (r not in least or doc < least[r]):
            least[r] = doc
    got = [(r.doc_id, r.text or "") for r in ngram_join.dedup(docs).collect()]
    place = {pair: r for pair, r in zip(distinct, root)}
    assert sorted(place[pair] for pair in got) == sorted(set(root)) and all(pair[0] == least.get(place[pair]) for pair in got)


def test_directory_doubles_where_a_bucket_is_overfull():
    load = {p: 1 for p in range(16)} | {3: 100}
    depth, owner = exact_dedup.directory(load, capacity=4, max_depth=4)
    assert depth == 4 and owner[3] == 3 and owner[8:12] == [8] * 4 and owner[0:2] == [0, 0]
    assert exact_dedup.directory({}, 4, 4) == (0, [0])
    assert list(exact_dedup.chained([(0, 5, "a", 1, 1), (0, 5, "b", 2, 1), (0, 5, "a", 9, 2), (0, 6, "a", None, 1)])) == [
        (0, 5, 0, "a", 9, 3), (0, 5, 1, "b", 2, 1), (0, 6, 0, "a", None, 1)]
