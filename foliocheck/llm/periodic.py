"""Periodic runs of words: stretches in which every word equals the one a period before, repeated at least EXPONENT times.

Seed and extend on diagonals. A run of period q and length L matches itself at lag q over L - q words, so among the periods m to 2m - 1 every
run holds two equal k-grams at its lag, where k is the overlap that is guaranteed for all of them (5 words for m = 1, 6 for m = 2, then 3m).
The k-grams of a text are indexed by exact names (a name of 2p words is a pair of names of p words; names that occur once are left out, which
empties the index of ordinary prose after a few rounds). As k >= q, two occurrences of a k-gram inside a run lie exactly q apart with none
between, so only neighbouring occurrences are paired: at most one pair per word and round, never all pairs of a group. Pairs are extended along
their diagonal; a table of the furthest word that each lag has covered skips the pairs of a diagonal that is done.

All words of a slice of texts are one array, so work in Python is per run and per slice, not per word. Memory holds one slice (SLICE_BYTES, or
one longer text).

Defined cases: null, empty and blank texts have no words and no runs; each row is searched by itself, repeated rows alike; an empty table gives
no rows; other columns pass through, those named like an added column are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliocheck.llm.common import BLANKS, let, whole, words
from foliocheck.session import ship_package

MIN_LENGTH = 6
EXPONENT = 4
SLICE_BYTES = 4 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def guaranteed_overlap(m: int, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> int:
    """Words that every run with a period of m to 2m - 1 shares with itself at its lag."""
    return min(max(min_length - q, (exponent - 1) * q) for q in range(m, 2 * m if m < min_length else m + 1))


def _equal_for(seq: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How far seq[a..] and seq[b..] agree, forwards (step 1) or backwards (-1), at most `most` words; looked at in growing blocks."""
    done, block = 0, 64
    while done < most:
        n = min(block, most - done)
        if step > 0:
            differ = seq[a + done:a + done + n] != seq[b + done:b + done + n]
        else:
            differ = (seq[a - done - n + 1:a - done + 1] != seq[b - done - n + 1:b - done + 1])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, block = done + n, block * 4
    return done


def _repeated(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the keys that occur more than once."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    keep = counts[names] > 1
    return at[keep], names[keep]


def find_runs(words_: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, over words of several texts one after the other; `doc` is the number of each word's text."""
    if exponent < 3:
        raise ValueError("neighbouring occurrences stand for all pairs from exponent 3 on")
    n = len(words_)
    if not n:
        return np.empty((0, 3), np.int64)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [n]])
    longest = int(np.diff(bounds).max())
    found: list[tuple[int, int, int]] = []
    at, names = _repeated(doc.astype(np.int64) * (int(words_.max()) + 1) + words_, np.arange(n))
    p, m = 1, 1
    while len(at) and max(min_length, exponent * m) <= longest:
        k = guaranteed_overlap(m, min_length, exponent)
        while 2 * p <= k:                                   # names of p words, p the largest power of two up to k
            at, names = _joined(at, names, p, doc, n)
            p *= 2
        seeds, seed_names = (at, names) if k == p else _joined(at, names, k - p, doc, n)
        order = np.argsort(seed_names, kind="stable")
        here, there = seeds[order][:-1], seeds[order][1:]
        lag = there - here
        near = (seed_names[order][:-1] == seed_names[order][1:]) & (lag >= m) & (lag < 2 * m)
        here, lag = here[near], lag[near]
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        # Pairs of one lag whose k-grams touch lie on one matching stretch of the diagonal.
        head = np.ones(len(here), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (here[1:] - here[:-1] > k)
        covered: dict[int, int] = {}
        own = np.searchsorted(bounds, here[head], "right")
        for i, q, first, end in zip(here[head].tolist(), lag[head].tolist(), bounds[own - 1].tolist(), bounds[own].tolist()):
            if i < covered.get(q, -1):
                continue
            left = i - _equal_for(words_, i - 1, i + q - 1, i - first, -1)
            right = i + _equal_for(words_, i, i + q, end - i - q, 1)
            covered[q] = right
            length = right - left + q
            if length >= max(min_length, exponent * q):
                found.append((left, length, q))
        m *= 2
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def _joined(at: np.ndarray, names: np.ndarray, shift: int, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the grams made of the gram at i and the gram at i + shift, for those that occur more than once in a text."""
    by_place = np.full(n + shift, -1, np.int64)
    by_place[at] = names
    other = by_place[at + shift]
    inside = other >= 0
    inside[inside] = doc[at[inside]] == doc[at[inside] + shift]
    return _repeated(names[inside] * (int(names.max()) + 1 if len(names) else 1) + other[inside], at[inside])


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(lengths):
        yield start, len(lengths)


def _search(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(runs, text without repeated periods) of each text of a slice."""
    trimmed = pc.utf8_trim(pc.fill_null(text, ""), characters=BLANKS)
    split = pc.split_pattern_regex(trimmed, "[ \t-\r]+")
    flat, sizes = split.flatten(), np.where(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy())
    flat = flat.filter(pc.not_equal(flat, ""))
    doc = np.repeat(np.arange(len(text)), sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    runs = find_runs(flat.dictionary_encode().indices.to_numpy().astype(np.int64), doc) if len(flat) else np.empty((0, 3), np.int64)
    owner = doc[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    keep = np.ones(len(flat), bool)
    for start, length, period in runs.tolist():
        keep[start + period:start + length] = False
    fields = [runs[:, 0] - bounds[owner], runs[:, 1], runs[:, 2]]
    listed = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(len(text) + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(_RUNS.value_type)))
    kept_before = np.concatenate([[0], np.cumsum(keep)])[bounds].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(kept_before, flat.filter(pa.array(keep))), " ")
    return listed, collapsed


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        names = [c for c in batch.schema.names if c not in ("runs", "collapsed")]
        for a, b in _slices(pc.fill_null(pc.binary_length(text), 0).to_numpy()):
            part = batch.slice(a, b - a)
            runs, collapsed = _search(part.column("text"))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], runs, collapsed], [*names, "runs", "collapsed"])


def collapse(docs: DataFrame) -> DataFrame:
    """`docs` with `runs`, by start and period, and `collapsed`: the words joined by one blank, of each run only those that stand in its first period
    or in no other run's repetition."""
    ship_package(docs.sparkSession)
    own = [f for f in docs.schema if f.name not in ("runs", "collapsed")]
    return docs.mapInArrow(_rows, T.StructType([*own, *T.StructType.fromDDL(f"runs {RUNS}, collapsed string")]))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared by cross products; of equals the first. Null without runs."""
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))


def written(runs: Column) -> Column:
    """One line `start,length,period` per run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def planted(doc_id: Column, text: Column) -> Column:
    """The words of a text joined by one blank where the hash of its id ends in 0, from some word on replaced by repetitions of the words there;
    the text itself elsewhere. It gives a corpus known runs to find."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(each: Column) -> Column:
        n = F.size(each).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda at: F.array_join(F.transform(each, lambda w, i: F.when(i < at["a"], w).otherwise(
            F.get(each, (at["a"] + (i - at["a"]) % at["p"]).cast("int")))), " "))

    return F.when((h % 10 == 0) & (F.btrim(whole(text), F.lit(BLANKS)) != ""), let(words(whole(text)), repeated)).otherwise(text)
