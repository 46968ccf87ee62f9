"""Personal data replaced by keyed surrogates.

Each entity (kind and canonical form) gets one surrogate for the whole corpus, drawn from a keyed hash: same kind, same format, for names
the same gender and script. The canonical form ignores case and separators, so every mention of an entity, however written, receives the
same surrogate in its own spelling. Surrogates are checked against each other and against the real entities of the corpus; the ones that
collide are drawn again until all are distinct. Entities are checked as a distributed table: nothing but a flag reaches the driver.

Names are detected behind titles, as many capitalised words as follow; each part between hyphens is a name of its own, the last word is the
surname. Every other mention of a detected name in the same text, capitalised and as a whole word, is replaced too. Behind a title that
tells no gender, a given name has the gender that the corpus tells of the same person, or else of the same given name; where it tells none
or both, the name stays name_x.

Defined cases: null and empty texts have no entities and stay as they are; overlapping matches go to the first in text order, the longer
one if they start together, then to the kind first in KINDS; rows that repeat a document are rewritten each; an empty table gives no rows;
other columns pass through, those named like an added column are replaced.
"""
from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliocheck.llm.common import whole
from foliocheck.session import cut_lineage, ship_package

KEY = b"replace with a secret of your own"
WIDEN = 4              # attempts before a format grows
KINDS = ["email", "iban", "ipv4", "card", "phone", "national_id", "name_f", "name_m", "name_x", "surname"]

_PATTERNS = {
    "email": r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "national_id": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
             r"|(?<![\w+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])",
}
#: Titles that announce a name, by the gender they tell.
_TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Госпожа", "госпожа", "Г-жа", "г-жа", "Пані", "пані"],
           "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "господин", "Г-н", "г-н", "Пан", "пан"],
           "x": ["Dr", "Prof", "Доктор", "доктор", "Д-р", "д-р", "Профессор", "профессор", "Проф", "проф"]}
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}
_TITLE = "(?:" + "|".join(_GENDER) + r")\b\.?"
_TITLED = re.compile(rf"(?<![\w-])(?:{_TITLE} )+")
#: A word of a name; small words that stand inside a name, and initials, stay as they are.
_STEP = re.compile(r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ten|ter|zu) |[^\W\d_]\.[ -]?)*([^\W\d_]+(?:[-'’][^\W\d_]+)*)")
_PART = re.compile(r"(['’]?)([^\W\d_]{2,})")
_MENTION = re.compile(r"\b[^\W\d_]{2,}\b")
#: Surrogate names by script and gender.
_NAMES = {
    ("latin", "f"): "Adela Berta Celia Dora Edith Flora Greta Helga Irma Judith Klara Lydia Marta Nora Olga Paula Rita Sonja Thea Vera".split(),
    ("latin", "m"): "Albert Bruno Conrad David Emil Felix Georg Hugo Ivan Julius Karl Leon Martin Norbert Oskar Paul Robert Stefan Theo Viktor".split(),
    ("latin", "s"): "Adler Bauer Conti Duran Engel Ferrer Gruber Hansen Ibarra Jansen Keller Lorca Moreau Navarro Olsen Perrin Quint Rossi Soler Vidal".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Марина Нина Ольга Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Максим Олег Павел Роман".split(),
    ("cyrillic", "s"): "Белов Волков Громов Демин Жуков Зимин Котов Лосев Орлов Фомин".split(),
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
#: What every pattern above needs at least.
_HINT = re.compile(r"[\d@]")


def _titled(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, person) of the names behind titles; the person of a given name is its whole name."""
    out = []
    for m in _TITLED.finditer(text):
        told = {_GENDER[t] for t in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", m.group())} - {"x"}
        gender = told.pop() if len(told) == 1 else "x"
        words, at = [], m.end()
        while (step := _STEP.match(text, at)) and step.group(1)[0].isupper() and step.group(1) not in _GENDER:
            parts = _PART.finditer(text, step.start(1), step.end(1))
            words.append([part.span(2) for part in parts if not part.group(1) or part.group(2)[0].isupper()])
            if not text.startswith(" ", step.end()):
                break
            at = step.end() + 1
        words = [w for w in words if w]
        person = canonical("surname", "".join(text[a:b] for w in words for a, b in w))
        out += [(a, b, "surname" if w is words[-1] else f"name_{gender}", "" if w is words[-1] else person, gender if len(words) == 1 else "")
                for w in words for a, b in w]
    # A single name behind a title is a surname, unless the text knows it as a given name only.
    given = {text[a:b].casefold(): (kind, person) for a, b, kind, person, _ in out if kind != "surname"}
    family = {text[a:b].casefold() for a, b, kind, _, alone in out if kind == "surname" and not alone}

    def settled(a: int, b: int, kind: str, person: str, alone: str) -> tuple[int, int, str, str]:
        name = text[a:b].casefold()
        if alone and name in given and name not in family:
            kind, person = given[name]
            kind = f"name_{alone}" if kind == "name_x" else kind
        return a, b, kind, person

    return [settled(*found) for found in out]


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order and without overlap."""
    return [span[:3] for span in _found(text)]


def _found(text: str | None) -> list[tuple[int, int, str, str]]:
    """`find` with the person that a given name belongs to."""
    spans = []
    if text and _HINT.search(text):
        spans = [(m.start(), m.end(), m.lastgroup, "") for m in _ANY.finditer(text)]
    titled = _titled(text or "")
    if titled:
        places, names = {a for a, *_ in titled}, {}
        for a, b, *what in titled:
            names.setdefault(text[a:b].casefold(), what)
        spans += titled
        for m in _MENTION.finditer(text):
            if m.start() not in places and m.group()[0].isupper() and (what := names.get(m.group().casefold())):
                spans.append((*m.span(), *what))
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if span[0] >= at:
            out.append(span)
            at = span[1]
    return out


def canonical(kind: str, surface: str) -> str:
    """What makes two mentions the same entity: case never matters, separators only in addresses."""
    folded = surface.casefold()
    return folded if kind in ("email", "ipv4") else re.sub(r"[\W_]", "", folded) or folded


class _Draw:
    """Keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, name: str, attempt: int):
        self.seed, self.key, self.block, self.held = f"{kind}\x00{name}\x00{attempt}".encode("utf-8", "surrogatepass"), key, 0, []

    def below(self, n: int) -> int:
        if not self.held:
            self.held = list(hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest())
            self.block += 1
        return (self.held.pop() * 256 + (self.held.pop() if self.held else 0)) % n


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def surrogate(kind: str, name: str, attempt: int, key: bytes = KEY) -> str:
    """The canonical surrogate of an entity: letters for letters of the same script, digits for digits, everything else as it is.

    A short format has few surrogates. From attempt WIDEN on it grows by one sign for every two attempts (an address uses the whole range of its
    octets), so that entities of one shape, however many, all find one.
    """
    draw = _Draw(key, kind, name, attempt)
    wider = max(0, attempt - WIDEN + 2) // 2
    if kind.startswith("name_") or kind == "surname":
        script = "cyrillic" if "Ѐ" <= name[:1] <= "ӿ" else "latin"
        gender = "s" if kind == "surname" else kind[-1] if kind != "name_x" else "fm"[draw.below(2)]
        chosen = _NAMES[script, gender][draw.below(len(_NAMES[script, gender]))].casefold()
        # The lists are short: later attempts add syllables of their own, so that names never run out.
        vowels, consonants = ("аеио", "бвдклмнрст") if script == "cyrillic" else ("aeio", "bdklmnrst")
        return chosen + "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range((attempt + 1) // 2))
    if kind == "ipv4":
        def octet(old: str) -> str:
            low, high = (1, 254) if wider else {1: (1, 9), 2: (10, 99)}.get(len(old), (100, 254))
            return str(low + draw.below(high - low + 1))
        return ".".join(map(octet, name.split(".")))
    tail = name.rfind(".") if kind == "email" else len(name)      # the top-level domain stays
    kept = 2 if kind == "iban" else 1 if kind in ("card", "phone") else 0
    out = []
    for i, c in enumerate(name):
        if i < kept or i > tail:
            out.append(c)
        elif c.isdecimal():
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z":
            out.append("abcdefghijklmnopqrstuvwxyz"[draw.below(26)])
        elif c.isalpha() and c.lower() != c.upper():
            base = ord(c) & ~15
            letters = [chr(x) for x in range(base, base + 16) if chr(x).isalpha() and chr(x) == chr(x).casefold()] or [c]
            out.append(letters[draw.below(len(letters))])
        else:
            out.append(c)
    made = "".join(out)
    if kind == "email":
        made = "".join("abcdefghijklmnopqrstuvwxyz"[draw.below(26)] for _ in range(wider)) + made
    else:
        made += "".join(str(draw.below(10)) for _ in range(wider))
    if kind == "card" and _luhn(name):
        made = next(made[:-1] + d for d in "0123456789" if _luhn(made[:-1] + d))
    return made


def rendered(kind: str, surface: str, made: str) -> str:
    """A canonical surrogate in the spelling of one mention: its separators and its use of capitals."""
    if kind in ("name_f", "name_m", "name_x", "surname"):
        return made.upper() if surface.isupper() else made.title()
    if kind in ("email", "ipv4"):
        return made.upper() if surface.isupper() else made if kind == "ipv4" or len(made) != len(surface) else "".join(
            m.upper() if s.isupper() else m for s, m in zip(surface, made))
    letters = iter(made)
    spelled = "".join((lambda m: m.upper() if c.isupper() else m)(next(letters, "")) if c.isalnum() else c for c in surface)
    return spelled + "".join(letters)


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, kind, surface, entity, person of every mention."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<struct<start:int,end:int,kind:string,surface:string,entity:string,person:string>>")
    def detect(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[(a, b, k, t[a:b], canonical(k, t[a:b]), p) for a, b, k, p in _found(t)] for t in batch], dtype=object)

    return (docs.select("doc_id", F.xxhash64(whole("text")).alias("text_hash"), F.explode(detect("text")).alias("m"))
            .select("doc_id", "text_hash", "m.*").dropDuplicates(["doc_id", "text_hash", "start"]))


def genders(found: DataFrame) -> DataFrame:
    """kind, entity, person of `found` and `told`, the kind with the gender that is known of a name_x."""
    names = found.select("kind", "entity", "person").distinct()
    known = names.filter(F.col("kind").isin("name_f", "name_m"))

    def only(name: str, *key: str) -> DataFrame:
        return known.groupBy(*key).agg(F.min("kind").alias(name), F.max("kind").alias("__llm_other")).filter(F.col(name) == F.col("__llm_other")).drop("__llm_other")

    open_names = names.filter("kind = 'name_x'").join(only("by_person", "entity", "person"), ["entity", "person"], "left").join(only("by_name", "entity"), ["entity"], "left")
    return (names.filter("kind <> 'name_x'").withColumn("told", F.col("kind"))
            .unionByName(open_names.select("kind", "entity", "person", F.coalesce("by_person", "by_name", "kind").alias("told"))))


def surrogates(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, entity, made: one distinct surrogate per entity, equal to no entity of the same kind."""
    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(*row, key) for row in zip(kind, entity, attempt)], dtype=object)

    real = cut_lineage(found.select("kind", "entity").distinct())
    table = real.withColumn("attempt", F.lit(0))
    while True:
        # An entity that had its surrogate first keeps it; the others, and those that hit a real entity, draw again.
        drawn = table.withColumn("made", draw("kind", "entity", "attempt"))
        first = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "entity")).alias("first"))
        taken = drawn.join(first, ["kind", "made"]).join(real.select("kind", F.col("entity").alias("made"), F.lit(True).alias("is_real")), ["kind", "made"], "left")
        judged = cut_lineage(taken.withColumn("clash", (F.col("first.entity") != F.col("entity")) | F.coalesce("is_real", F.lit(False))).drop("first"))
        if judged.filter("clash").isEmpty():
            return judged.select("kind", "entity", "made")
        table = judged.select("kind", "entity", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def pseudonymize(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """`docs` with `text` rewritten and `entities`, the number of replaced mentions per kind."""
    found = cut_lineage(mentions(docs))
    told = cut_lineage(genders(found))
    entities = told.select(F.col("told").alias("kind"), "entity")
    made = told.join(surrogates(entities, key).withColumnRenamed("kind", "told"), ["told", "entity"])
    named = found.join(made, ["kind", "entity", "person"]).withColumn("kind", F.col("told"))

    @F.pandas_udf("string")
    def spell(kind: pd.Series, surface: pd.Series, made: pd.Series) -> pd.Series:
        return pd.Series([rendered(*row) for row in zip(kind, surface, made)], dtype=object)

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, edits: pd.Series) -> pd.Series:
        def one(text, spans):
            if text is None or spans is None or not len(spans):
                return text
            out, at = [], 0
            for span in spans:
                out += [text[at:span["start"]], span["spelled"]]
                at = span["end"]
            return "".join(out) + text[at:]
        return pd.Series([one(t, e) for t, e in zip(texts, edits)], dtype=object)

    edits = (named.withColumn("spelled", spell("kind", "surface", "made")).groupBy(F.col("doc_id").alias("__llm_doc"), F.col("text_hash").alias("__llm_hash"))
             .agg(F.sort_array(F.collect_list(F.struct("start", "end", "spelled", "kind"))).alias("__llm_edits")))
    joined = docs.drop("entities").join(edits, F.col("doc_id").eqNullSafe(F.col("__llm_doc")) & (F.xxhash64(whole("text")) == F.col("__llm_hash")), "left")
    counts = F.struct(*[F.coalesce(F.size(F.filter("__llm_edits", _is(k))), F.lit(0)).alias(k) for k in KINDS])
    return joined.select(*[c for c in docs.columns if c not in ("text", "entities")],
                         F.when(F.col("__llm_edits").isNull(), F.col("text")).otherwise(rewrite("text", F.col("__llm_edits"))).alias("text"), counts.alias("entities"))


def _is(kind: str):
    return lambda edit: edit["kind"] == kind
