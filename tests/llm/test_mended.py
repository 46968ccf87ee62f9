"""Rows without ids, repeated ids, short formats and callers' own columns."""
import random

import numpy as np
from pyspark.sql import functions as F

from foliocheck.llm import exact_dedup, language_id, mixing, ngram_join, pii, toxicity
from foliocheck.llm.ngrams import Distinct
from tests.llm import cases


def test_rows_without_an_id_link_like_others(spark):
    words = cases.prose(3, 30)
    rows = [(1, words + " a"), (None, words), (None, words + " b"), (None, words), (None, cases.prose(8, 30)), (None, cases.prose(8, 30) + " c"), (7, cases.prose(9, 30)), (None, None)]
    docs = cases.frame(spark, [(i, t, "en", "s", 1) for i, t in rows]).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()), key=repr)
    assert got == sorted([(1, 27, 1), (None, 26, 1), (None, 26, 1), (None, 27, 1), (None, 26, None), (None, 27, None), (7, 26, 7), (None, 0, None)], key=repr)
    kept = [(r.doc_id, r.text) for r in ngram_join.dedup(docs).collect()]
    assert (1, words + " a") in kept and (7, rows[6][1]) in kept and len(kept) == 4
    assert len({text for _, text in kept} & {rows[4][1], rows[5][1]}) == 1


def test_bridges_through_rows_without_an_id(spark):
    words = cases.prose(4, 200).split()
    steps = [" ".join(words[k:k + 100]) for k in (0, 12, 24)]
    rows = [(1, steps[0]), (None, steps[1]), (3, steps[2])]
    got = {(r.doc_id, r.component_id) for r in ngram_join.link_documents(cases.frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()}
    assert got == {(1, 1), (None, 1), (3, 1)}


def tongue(number: int) -> list[str]:
    rng = random.Random(number)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 5))) for _ in range(12)]


def speak(number: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(tongue(number), k=40))


def test_more_languages_than_any_limit(spark):
    rows = [(i, speak(i % 80, i), f"l{i % 80:02}") for i in range(80 * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, F.col("doc_id") < 400, landmarks=3)
    assert len(model.langs) == 80
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows if i >= 400) >= 78


def test_language_kernel_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "COLUMNS", 64)
    rows = [(i, speak(i % 4, i), f"l{i % 4}") for i in range(60)] + [(60, "", "l0"), (61, "x", "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, landmarks=5)
    distinct = Distinct(language_id.BITS)
    lists = [language_id.features(text, distinct) for _, text, _ in rows]
    slots = np.unpackbits(model.landmarks, axis=1, count=len(model.root_size)).astype(bool)
    landmarks = [set(np.flatnonzero(model.column >= 0)[slots[:, j]].tolist()) for j in range(slots.shape[1])]
    want = [[len(set(x.tolist()) & mark) / max(len(x) * len(mark), 1) ** 0.5 for mark in landmarks] for x in lists]
    np.testing.assert_allclose(language_id._kernel(lists, model), want, atol=1e-5)
    assert {frozenset(x) for x in landmarks} <= {frozenset(x.tolist()) for x in lists}


def test_a_repeated_id_is_one_row_of_a_sample(spark, monkeypatch):
    seen = []
    rows = [(1, speak(0, 1), "l0")] * 400 + [(i, speak(i % 2, i), f"l{i % 2}") for i in range(2, 42)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    vectors = language_id._vectors
    monkeypatch.setattr(language_id, "_vectors", lambda lists, m: (seen.append(len(lists)), vectors(lists, m))[1])
    language_id.fit(docs)
    assert sum(seen) == 41
    sizes = []
    regress = toxicity._regress
    monkeypatch.setattr(toxicity, "_regress", lambda lists, y, ratio: (sizes.append(len(y)), regress(lists, y, ratio))[1])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 42)], "doc_id long, label int")
    toxicity.fit(docs, labels, min_docs=0, min_ratio=0)
    toxicity.fit(docs, labels, max_train=8, min_docs=0, min_ratio=0)
    assert sizes == [41, 8]


def test_short_formats_widen_until_all_are_distinct(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.org" for a in letters for b in letters]
    found = [("email", m) for m in mails] + [("ipv4", f"{a}.{b}.{c}.{d}") for a in range(1, 8) for b in range(1, 8) for c in range(1, 8) for d in range(1, 7)] + [("phone", f"1{n:04}") for n in range(2000)]
    rows = pii.surrogates(spark.createDataFrame(found, "kind string, entity string")).collect()
    made = {(r.kind, r.made) for r in rows}
    assert len(rows) == len(found) == len(made) and not made & set(found)
    assert all(r.made.endswith(".org") for r in rows if r.kind == "email")
    assert pii.rendered("phone", "+1 22 33", "1445566") == "+1 44 5566"


def test_a_single_name_behind_a_title_is_the_person_named_before(spark):
    texts = ["Mr John Smith came. Mr John left.", "Dr Kim. Mrs Kim Ray.", "Mr Smith came with Mrs Smith Jones and Mr Paul Smith."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymize(rows).collect()}
    first = got[0].split()
    assert first[1] == first[5] and first[1] != "John" and first[2] != "Smith"
    second = got[1].replace(".", "").split()
    assert second[1] == second[3] and second[1] != "Kim"
    assert "Smith" not in got[2]


def test_callers_columns_survive(spark, odd, empty):
    own = odd.withColumns({c: F.lit("mine") for c in ("src", "turn", "before", "sent", "no_source", "bucket", "chain", "epoch", "tick")})
    mixed = mixing.mix(own)
    kept = [c for c in own.columns if c not in ("size", "taken")]
    assert set(kept) <= set(mixed.columns)
    rows = mixed.collect()
    assert len(rows) == len(cases.odd_rows()) and all(r[c] == "mine" for r in rows for c in ("src", "chunk", "turn", "cut", "h", "epoch", "tick"))
    members = exact_dedup.members(own, exact_dedup.build_index(own)).collect()
    assert len(members) == len(cases.odd_rows()) and all(r.h == r.bucket == r.chain == "mine" for r in members)
    assert mixing.mix(empty).collect() == []
    nameless = cases.frame(spark, [(None, cases.prose(i, 20), "en", "a", 1) for i in range(50)])
    assert mixing.sized(nameless).select("__llm_chunk").distinct().count() > 40
