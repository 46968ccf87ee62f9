"""Toxicity score: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams of a text. Each is scaled by the log ratio of its smoothed document frequency among toxic and
among other labelled texts; a regularised logistic regression over the scaled features is then fitted by accelerated gradient steps. The
model is fitted on at most `max_train` labelled rows (those with the smallest hash of doc_id, so reruns agree) and sent to the tasks as one
vector of 2 ** BITS weights, whatever the size of the corpus. Scoring is one pass over the texts without a shuffle.

The fit selects its features: an n-gram that fewer than `min_docs` sampled texts hold, or whose ratio is below `min_ratio` either way, has weight
0. That leaves out no row and no text of the sample; 0 for both keeps every n-gram.

Defined cases: null and empty texts get the score of the bare intercept; labels without a document, null labels and null texts are not
learned from; repeated label rows of a document count once (the largest label), so do repeated rows of an id (the smallest text); without labels of both kinds every score is the share of
toxic labels, 0 if there are none; an empty table gives no rows; other columns pass through, those named like an added column are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliocheck.llm.ngrams import Distinct, codes, hashed
from foliocheck.session import cut_lineage, ship_package

ORDERS = (4, 5, 6)
BITS = 18
MAX_TRAIN = 5000       # labelled rows the model is fitted on
MIN_DOCS = 4           # an n-gram in fewer of them is left out
MIN_RATIO = 1.5        # so is one whose log ratio is smaller
ALPHA = 1.0
PENALTY = 1e-3
STEPS = 200
TASKS = 16             # tasks that read the sampled texts


def features(text: str | None, distinct: Distinct) -> np.ndarray:
    points = codes(text or "")
    return distinct(np.concatenate([hashed(points, n, BITS) for n in ORDERS]))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per label of this task: documents, and how many of them have each n-gram."""
    distinct, docs, counts = Distinct(BITS), [0, 0], np.zeros((2, 1 << BITS), dtype=np.int32)
    for batch in batches:
        for label, text in zip(batch["label"], batch["text"]):
            docs[label > 0] += 1
            counts[int(label > 0), features(text, distinct)] += 1
    yield pd.DataFrame({"label": [0, 1], "docs": docs, "counts": [c.tobytes() for c in counts]})


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, min_docs: int = MIN_DOCS, min_ratio: float = MIN_RATIO) -> tuple[np.ndarray, float]:
    """(weights by slot, intercept). `docs` has doc_id and text, `labels` doc_id and label 0/1; both may be larger than the sample.

    TASKS tables of counts reach the driver, and of each sampled text only the n-grams whose ratio tells something.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    texts = cut_lineage(texts.repartition(TASKS))
    size, n, counts = 1 << BITS, np.zeros(2), np.zeros((2, 1 << BITS))
    for row in texts.mapInPandas(_frequencies, "label int, docs long, counts binary").toLocalIterator():
        n[row.label] += row.docs
        counts[row.label] += np.frombuffer(row.counts, dtype=np.int32)
    if n.min() == 0:
        share = float(n[1] / n.sum()) if n.sum() else 0.0
        return np.zeros(size), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    ratio = np.log((counts[1] + ALPHA) / (n[1] + 2 * ALPHA)) - np.log((counts[0] + ALPHA) / (n[0] + 2 * ALPHA))
    ratio[counts.sum(axis=0) < min_docs] = 0.0
    telling = spark.sparkContext.broadcast(np.abs(ratio) >= min_ratio)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct = Distinct(BITS)
        for batch in batches:
            found = [features(t, distinct) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "slots": [x[telling.value[x]].astype(np.int32).tobytes() for x in found]})

    rows = texts.mapInPandas(pack, "label int, slots binary").toPandas()
    order = rows.sort_values(["label", "slots"], kind="stable")
    return _regress([np.frombuffer(x, dtype=np.int32) for x in order["slots"]], (order["label"] > 0).to_numpy(dtype=float), ratio)


def _regress(lists: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression over presence times ratio, by accelerated gradient steps; both labels weigh the same."""
    cols = np.concatenate(lists)
    used, cols = np.unique(cols, return_inverse=True)
    row = np.repeat(np.arange(len(y)), [len(x) for x in lists])
    value = ratio[used][cols]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b = np.zeros(len(used)), 0.0
    norm = max(np.bincount(row, value * value, len(y)).max(), 1.0)
    rate, ahead, last = 4.0 / norm, w.copy(), w.copy()
    for step in range(1, STEPS + 1):
        z = np.bincount(row, value * ahead[cols], len(y)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        last, w = w, ahead - rate * len(y) ** 0.5 * (np.bincount(cols, value * error[row], len(used)) / len(y) + PENALTY * ahead)
        ahead = w + (step - 1) / (step + 2) * (w - last)
        b -= 0.5 * float(error.mean())
    weights = np.zeros(len(ratio))
    weights[used] = w * ratio[used]
    return weights, b


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 if the score is 0.5 or more)."""
    ship_package(docs.sparkSession)
    weights, intercept = model
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf(T.DoubleType())
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distinct, w = Distinct(BITS), sent.value
        for batch in texts:
            z = np.array([intercept + float(w[features(t, distinct)].sum(dtype=np.float64)) for t in batch])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.drop("score", "predicted").withColumn("score", rate("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
