"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams of one to three characters that both contain (a blended spectrum of presence),
over the geometric mean of their own numbers. A Nyström map over `landmarks` labelled texts turns it into vectors, on which one kernel
ridge regression per language is fitted against the rest. The model is fitted on at most `max_train` labelled rows per language (those
with the smallest hash of doc_id, so reruns agree). Texts are scored in batches by three matrix products: presence by landmark n-grams,
landmark kernels by the Nyström map, vectors by the ridge weights. All languages are learned, and every n-gram of a landmark counts; presence is
multiplied COLUMNS n-grams at a time, landmarks are sent as bits, so memory stays small whatever their number.

Defined cases: a row without an id is not learned from, an id that is repeated in a language is one row of it (the smallest text); a null text, or one without a letter, is `und` with score 0; rows with a null language or text are not learned from; equal
scores go to the language first by code point; without any labelled row all texts are `und`; an empty table gives no rows; other columns
pass through, those named like an added column are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliocheck.llm.ngrams import Distinct, codes, hashed
from foliocheck.session import ship_package

ORDERS = (1, 2, 3)
BITS = 16
MAX_TRAIN = 300        # labelled rows per language that the ridge is fitted on
LANDMARKS = 24         # of them, those that serve as landmarks
COLUMNS = 4096         # n-grams that one product takes
PENALTY = 1e-2
BATCH = 512


def features(text: str, distinct: Distinct) -> np.ndarray:
    """Distinct slots of the n-grams of a text; digits and signs are left out of it beforehand."""
    points = codes(text)
    letter = (points >= 97) & (points <= 122) | (points > 127)
    points = np.where(letter, points, 32).astype(np.uint32)
    points = points[(points != 32) | (np.concatenate(([1], points[:-1])) != 32)]
    return distinct(np.concatenate([hashed(points, n, BITS) for n in ORDERS]))


@dataclass
class Model:
    langs: list[str]
    column: np.ndarray      # slot -> column of the presence matrix, -1 if no landmark has it
    landmarks: np.ndarray   # columns x landmarks, presence as packed bits
    root_size: np.ndarray   # square root of the number of each landmark's n-grams
    to_vector: np.ndarray   # Nyström map
    ridge: np.ndarray       # (vector + 1) x languages


def _root_size(lists: list[np.ndarray]) -> np.ndarray:
    """Square root of the number of distinct n-grams of each text."""
    return np.sqrt(np.maximum([len(x) for x in lists], 1)).astype(np.float32)


def _kernel(lists: list[np.ndarray], m: Model) -> np.ndarray:
    """Texts x landmarks: n-grams in common over the geometric mean of both numbers."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = m.column[np.concatenate(lists)] if lists else np.empty(0, np.int32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((len(lists), len(m.root_size)), dtype=np.float32)
    for start in range(0, len(m.landmarks), COLUMNS):
        marks = np.unpackbits(m.landmarks[start:start + COLUMNS], axis=1, count=len(m.root_size)).astype(np.float32)
        a, b = np.searchsorted(at, (start, start + len(marks)))
        x = np.zeros((len(lists), len(marks)), dtype=np.float32)
        x[row[a:b], at[a:b] - start] = 1
        shared += x @ marks
    return shared / (_root_size(lists)[:, None] * m.root_size[None, :])


def _vectors(lists: list[np.ndarray], m: Model) -> np.ndarray:
    return np.hstack([_kernel(lists, m) @ m.to_vector, np.ones((len(lists), 1), dtype=np.float32)])


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    distinct = Distinct(BITS)
    for batch in batches:
        yield pd.DataFrame({"lang": batch["lang"], "place": batch["place"], "slots": [features(t, distinct).astype(np.int32).tobytes() for t in batch["text"]]})


def fit(docs: DataFrame, learn: Column | bool = True, max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS) -> Model | None:
    """A model from the rows of `docs` (doc_id, text, lang) for which `learn` holds; None without any."""
    ship_package(docs.sparkSession)
    known = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    usable = docs.filter(known & (F.lit(learn) if isinstance(learn, bool) else learn)).select("doc_id", "lang").distinct()
    # Ids are cut to the sample before any text is read; per language, each task first keeps its own smallest.
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    local = Window.partitionBy("lang", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(64))).orderBy(F.xxhash64("doc_id"), "doc_id")
    near = usable.withColumn("r", F.row_number().over(local)).filter(F.col("r") <= max_train)
    chosen = near.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= max_train).select("doc_id", "lang", "place")
    texts = docs.select("doc_id", "lang", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), ["doc_id", "lang"])
    texts = texts.groupBy("lang", "place").agg(F.min("text").alias("text"))
    rows = texts.mapInPandas(_pack, "lang string, place int, slots binary").toPandas().sort_values(["lang", "place", "slots"], kind="stable")
    if rows.empty:
        return None
    lists = [np.frombuffer(x, dtype=np.int32) for x in rows["slots"]]
    langs = sorted(rows["lang"].unique())
    chosen_rows = np.flatnonzero(rows["place"].to_numpy() <= landmarks)
    marks = [lists[i] for i in chosen_rows]
    grams = np.unique(np.concatenate(marks))
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[grams] = np.arange(len(grams))
    present = np.zeros((len(grams), len(marks)), dtype=bool)
    for i, slots in enumerate(marks):
        present[column[slots], i] = True
    model = Model(langs, column, np.packbits(present, axis=1), _root_size(marks), np.eye(len(marks), dtype=np.float32), np.empty(0))
    among = np.vstack([_kernel(marks[i:i + BATCH], model) for i in range(0, len(marks), BATCH)])
    value, vector = np.linalg.eigh(among.astype(np.float64))
    keep = value > 1e-6 * value.max()
    model.to_vector = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    z = np.vstack([_vectors(lists[i:i + BATCH], model) for i in range(0, len(lists), BATCH)]).astype(np.float64)
    # Every language weighs the same in its regression, however many rows it has.
    sides = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang in rows["lang"]])
    weight = 1.0 / rows.groupby("lang")["lang"].transform("size").to_numpy(dtype=float)
    gram = z.T @ (z * weight[:, None])
    model.ridge = np.linalg.solve(gram + PENALTY * np.eye(z.shape[1]), z.T @ (sides * weight[:, None])).astype(np.float32)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with `lang_pred` and `score` (0 to 1)."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        distinct, m = Distinct(BITS), sent.value
        for batch in texts:
            langs, scores = np.full(len(batch), "und", dtype=object), np.zeros(len(batch))
            able = [i for i, t in enumerate(batch) if m is not None and t is not None and any(map(str.isalpha, t))]
            for start in range(0, len(able), BATCH):
                at = able[start:start + BATCH]
                side = _vectors([features(batch.iloc[i], distinct) for i in at], m) @ m.ridge
                langs[at] = np.array(m.langs, dtype=object)[side.argmax(axis=1)]
                scores[at] = np.clip((side.max(axis=1) + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.drop("lang_pred", "score").withColumn("__llm_p", predict("text")).select("*", "__llm_p.lang_pred", "__llm_p.score").drop("__llm_p")
