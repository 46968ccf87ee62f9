"""Language, toxicity, BPE and PII on small inputs."""
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from foliocheck.llm import bpe, language_id, pii, toxicity
from tests.llm import cases

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def real(text: str) -> list[int]:
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    return coding.encode_ordinary(text)


def test_bpe_equals_the_library(spark, odd, empty):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeinorstué  \n\t.,!'12日本語اب\U0001f600") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["a" * 3000, "the" * 2000, " " * 2000 + "x", "don't we'll IT'S", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == real(r.text) and bytes(r.decoded) == r.text.encode()
    for r in bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == real(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_by_higher_order_functions(spark):
    texts = [None, "", "Hello  wörld, don't merge!\n\n 1234 日本語", "aaaaaaaa abababab"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.encode_by_words(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == real(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


LANGS = {"xx": "ka ti mo ru pela sonti mara", "yy": "schun gefen ichter wald ung keit", "zz": "eau oix tion que ement leur"}


def speak(lang: str, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(LANGS[lang].split(), k=rng.randint(1, 3))) for _ in range(30))


def test_language_on_held_out_rows(spark, odd, empty):
    rows = [(i, speak(lang, i), lang) for i, lang in enumerate(list(LANGS) * 40)]
    docs = spark.createDataFrame(rows + [(900, None, "xx"), (901, "123 ...", "yy"), (902, speak("xx", 902), None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.col("doc_id") % 4 != 1)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 118
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.fit(empty) is None and {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(empty, model).collect() == [] and language_id.identify(odd, model).count() == len(cases.odd_rows())


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rows = [(i, cases.prose(i, 60) + (" you filthy gronk " if i % 5 == 0 else " ") + cases.prose(-i, 60)) for i in range(1, 600)]
    docs = spark.createDataFrame(rows + [(0, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows if i % 3] + [(1, 0), (None, 1), (2, None), (5000, 1)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i].predicted == int(i % 5 == 0) for i, _ in rows if i % 3 == 0) >= 195
    assert got[0].score == got[1000].score < 0.5
    one_kind = toxicity.fit(docs, labels.filter("label = 0"))
    assert {r.predicted for r in toxicity.score(odd, one_kind).collect()} == {0}
    assert toxicity.score(empty, model).collect() == [] and toxicity.score(odd, model).count() == len(cases.odd_rows())
    assert toxicity.fit(empty, labels)[1] < 0


def test_pii_surrogates(spark, odd, empty):
    texts = ["Write to Ann.Lee@Mail.example.org or ann.lee@mail.example.org, call +1 (771) 555-1655.", "From 10.20.30.40 and 1.2.3.4, card 4111 1111 1111 1111.",
             "Card 4111-1111-1111-1111; call +1 771 555 1655. Mrs. Jane Miller met Mr Miller and Dr. MILLER.", "DE44 5001 0517 5407 3249 31 and 123-45-6789", None, "plain"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(docs).collect()}
    for i, text in enumerate(texts):
        for start, end, _ in pii.find(text):
            assert text[start:end] not in got[i].text
    first, second, third = (got[i].text for i in range(3))
    mails = re.findall(r"[\w.]+@[\w.]+", first)
    assert mails[0].lower() == mails[1].lower().rstrip(",") and mails[0][0].isupper() and mails[0].endswith(".org")
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(first.split("call")[1]) == digits(third.split("call")[1].split("Mrs")[0])
    card = digits(second.split("card")[1])
    assert card == digits(third.split(";")[0]) and sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(card))) % 10 == 0
    names = third.split("Mrs. ")[1]
    assert len(set(re.findall(r"(?:met Mr |Dr\. |^\w+ )(\w+)", names.casefold().replace("mr", "Mr").replace("dr", "Dr")))) == 1
    assert names.split()[0] in pii._NAMES["latin", "f"]
    assert got[4].text is None and got[5].text == "plain" and got[1].entities.ipv4 == 2
    assert pii.pseudonymize(odd).count() == len(cases.odd_rows()) and pii.pseudonymize(empty).collect() == []


@pytest.mark.parametrize("kind, entity", [("email", "a@b.org"), ("iban", "DE44 5001 0517 5407 3249 31"), ("ipv4", "8.8.8.8"), ("ipv4", "1.2.3.4"),
                                          ("national_id", "123-45-6789"), ("card", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"), ("card", "4-1-1-1-1-1-1-1-1-1-1-1-1"),
                                          ("phone", "(77) 555 1655"), ("phone", "+1 77 555 1655"), ("phone", "771 555 1655")])
def test_pii_finds_each_kind_alone(kind, entity):
    assert pii.find(f"resolver at {entity} answers") == [(12, 12 + len(entity), kind)]


def test_pii_names_are_replaced_at_every_mention(spark):
    texts = ["Mr John Smith came. Smith said so; JOHN agreed, and smithy did not. Goldsmith, Smith's.", "Earlier Jones. Mrs Jane Smith-Jones spoke.", "Mr John Paul Smith slept.",
             "г-жа Анна Петрова и Петрова", "Prof. Dr. Anna Smith", "Mrs Anna Smith", "Herr Ludwig van Beethoven and Beethoven", "Mr J. Smith", "Dr Robin Brown",
             "Mr Kim Lee", "Mrs Kim Ray", "Dr Kim Ray", "Dr Kim Other", "the mr smith of no title case", "Mr O'Brien's cat met Mrs Jo Stone and Dr Mill. Brien, Stone, Mill; Cat"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymize(docs).collect()}
    got = {i: r.text for i, r in rows.items()}
    john, smith = re.match(r"Mr (\w+) (\w+) came", got[0]).groups()
    assert got[0] == f"Mr {john} {smith} came. {smith} said so; {john.upper()} agreed, and smithy did not. Goldsmith, {smith}'s."
    jones = re.match(r"Earlier (\w+)\.", got[1]).group(1)
    assert jones != "Jones" and re.fullmatch(rf"Earlier {jones}\. Mrs \w+ {smith}-{jones} spoke\.", got[1]) and "Jane" not in got[1]
    assert re.fullmatch(rf"Mr {john} (?!Paul)\w+ {smith} slept\.", got[2]) and got[7] == f"Mr J. {smith}"
    assert re.fullmatch(r"г-жа ([а-яА-Я]+) ([а-яА-Я]+) и \2", got[3]) and "Петрова" not in got[3] and "Анна" not in got[3]
    assert got[4].split()[2:] == got[5].split()[1:] and rows[4].entities.name_f == 1 and rows[4].entities.name_x == 0
    assert re.fullmatch(r"Herr (?!Ludwig)\w+ van (\w+) and \1", got[6]) and "Beethoven" not in got[6]
    assert rows[8].entities.name_x == 1 and got[13] == texts[13]
    assert [text for text in ("Brien", "Jo", "Stone", "Mill") if re.search(rf"\b{text}\b", got[14])] == [] and got[14].endswith("; Cat") and "'s cat met Mrs" in got[14]
    assert got[10].split()[1:] == got[11].split()[1:] and rows[11].entities.name_f == 1 and rows[12].entities.name_x == 1


def test_pii_surrogates_stay_distinct(spark):
    found = spark.createDataFrame([("ipv4", f"1.2.3.{i}") for i in range(10)] + [("name_f", f"name{i}") for i in range(300)], "kind string, entity string")
    rows = pii.surrogates(found).collect()
    assert len(rows) == 310 and len({(r.kind, r.made) for r in rows}) == 310
    assert not {(r.kind, r.made) for r in rows} & {(r.kind, r.entity) for r in rows}
