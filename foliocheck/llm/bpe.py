"""Byte-level BPE encoding and decoding with the ranks of a given vocabulary file.

Texts are split by the pattern of the vocabulary; each distinct word is a byte array on which ranked merges are folded: the adjacent pair
with the lowest rank, the leftmost of equal ones, becomes one piece until no pair has a rank. Decoding concatenates the binary pieces.

Defined cases: null text is empty and has no tokens; rows that repeat a document are encoded each; an empty table gives no rows; other
columns pass through, those named like an added column are replaced.
"""
from __future__ import annotations

import base64
import heapq
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliocheck.llm.common import let, whole
from foliocheck.session import ship_package

NO_RANK = 2147483647
BUCKETS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and rank. The file is as large as its vocabulary, whatever the corpus."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of small maps from hexadecimal piece to rank, so that a lookup scans one or two entries."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        piece = token.hex().upper()
        buckets[zlib.crc32(piece.encode()) % BUCKETS][piece] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(piece: Column, table: Column) -> Column:
    found = F.try_element_at(F.get(table, F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int")), piece)
    return F.coalesce(found, F.lit(NO_RANK))


def fold_merges(word: Column, table: Column) -> Column:
    """The token ids of a word: its bytes, with ranked merges folded over them."""
    none = F.array().cast("array<int>")

    def merge(state: Column, best: Column) -> Column:
        def at(p: Column) -> Column:
            pieces, ranks = state["pieces"], state["ranks"]
            n = F.size(pieces)
            def joined(piece: Column) -> Column:
                left = F.when(p > 1, F.array(_rank(F.concat(F.get(pieces, p - 2), piece), table))).otherwise(none)
                right = F.when(p + 1 < n, F.array(_rank(F.concat(piece, F.get(pieces, p + 1)), table))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(pieces, 1, p - 1), F.array(piece), F.slice(pieces, p + 2, n)).alias("pieces"),
                    F.concat(F.slice(ranks, 1, F.greatest(p - 2, F.lit(0))), left, right, F.slice(ranks, p + 2, n)).alias("ranks"))
            return let(F.concat(F.get(pieces, p - 1), F.get(pieces, p)), joined)
        return let(F.array_position(state["ranks"], best).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        return let(F.coalesce(F.array_min(state["ranks"]), F.lit(NO_RANK)), lambda best: F.when(best == NO_RANK, state).otherwise(merge(state, best)))

    def start(pieces: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces) - 1), lambda a, b: _rank(F.concat(a, b), table))
        return F.struct(pieces.alias("pieces"), pairs.alias("ranks"))

    one_by_one = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0))
    folded = let(one_by_one, lambda pieces: F.aggregate(F.sequence(F.lit(1), F.size(pieces)), start(pieces), step, lambda end: end["pieces"]))
    return F.transform(folded, lambda piece: _rank(piece, table))


def encode_by_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """`docs` with `ids` and `decoded`: distinct words are folded once for the whole corpus and joined back to the documents."""
    table = rank_map(ranks)
    tokens = F.regexp_extract_all(whole("text"), F.lit("(?U)" + pattern), F.lit(0))
    keyed = docs.drop("ids", "decoded").withColumn("__llm_key", F.xxhash64(whole("text"), "doc_id"))
    met = keyed.select("__llm_key", F.explode(F.array_distinct(tokens)).alias("word"))
    words = met.select("word").distinct().withColumn("ids", fold_merges(F.col("word"), table))
    known = met.join(words, "word").groupBy("__llm_key").agg(F.map_from_entries(F.collect_set(F.struct("word", "ids"))).alias("__llm_known"))
    joined = keyed.join(known, "__llm_key", "left").withColumn("__llm_ids", F.coalesce(F.flatten(F.transform(tokens, lambda t: F.try_element_at("__llm_known", t))), F.array().cast("array<int>")))
    piece = {rank: token for token, rank in ranks.items()}
    pieces = F.from_json(F.lit(json.dumps([piece.get(i, b"").hex() for i in range(max(piece) + 1)])), "array<string>")
    decoded = F.unhex(F.array_join(F.transform("__llm_ids", lambda i: F.get(pieces, i)), ""))
    return joined.select(*[c for c in docs.columns if c not in ("ids", "decoded")], F.col("__llm_ids").alias("ids"), decoded.alias("decoded"))


class Merger:
    """Ranked merges over many words at once, as array operations.

    Pieces are token ids. In each round every word merges its lowest-ranked adjacent pair, the leftmost of equal ones, and only the pairs
    beside a merge get new ranks. A word longer than LONG bytes would need as many rounds; it is merged alone over a heap of its pairs.
    """
    LONG = 256
    TABLE_BITS = 21

    def __init__(self, ranks: dict[bytes, int]):
        pairs = sorted((ranks[t[:i]] << 20 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.values = np.array([r for _, r in pairs], dtype=np.int32)
        # A hash table with one place per slot; keys that lost theirs are found by bisection.
        slots = self._slot(self.keys)
        self.table = np.full(1 << self.TABLE_BITS, -1, dtype=np.int32)
        self.table[slots] = np.arange(len(pairs))
        self.shared = np.bincount(slots, minlength=len(self.table)) > 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.piece_len = np.array([len(t) for t in tokens], dtype=np.int64)
        self.piece_start = np.concatenate(([0], np.cumsum(self.piece_len)))[:-1]
        self.pieces = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.TABLE_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of pieces, NO_RANK if they do not merge."""
        keys = left.astype(np.int64) << 20 | right
        slots = self._slot(keys)
        at = self.table[slots]
        hit = (at >= 0) & (self.keys[at] == keys)
        out = np.where(hit, self.values[at], NO_RANK)
        again = np.flatnonzero(~hit & self.shared[slots])
        if len(again):
            where = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            out[again] = np.where(self.keys[where] == keys[again], self.values[where], NO_RANK)
        return out

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        done_ids, done_words = [], []
        short = np.array([len(w) <= self.LONG for w in words], dtype=bool)
        for i in np.flatnonzero(~short):
            ids = self.fold_long(words[i])
            done_ids.append(np.array(ids, dtype=np.int32))
            done_words.append(np.full(len(ids), i))
        lens = np.array([len(w) if s else 0 for w, s in zip(words, short)], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), lens)
        ids = self.bytes[np.frombuffer(b"".join([w for w, s in zip(words, short) if s]), dtype=np.uint8)]
        rank = self._ranks_at(np.arange(len(ids)), ids, word)
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.concatenate((starts, [len(ids)])))
            open_words = np.repeat(best < NO_RANK, size)
            done_ids.append(ids[~open_words])
            done_words.append(word[~open_words])
            best = np.repeat(best, size)[open_words]
            ids, word, rank = ids[open_words], word[open_words], rank[open_words]
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))] if len(at) else at
            ids[at] = rank[at]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            rank[at] = self._ranks_at(at, ids, word)
            before = at[(at > 0)] - 1
            before = before[word[before] == word[before + 1]]
            rank[before] = self._ranks_at(before, ids, word)
        all_ids, all_words = np.concatenate(done_ids or [ids]), np.concatenate(done_words or [word])
        order = np.argsort(all_words, kind="stable")
        return all_ids[order], np.bincount(all_words, minlength=len(words))

    def _ranks_at(self, at: np.ndarray, ids: np.ndarray, word: np.ndarray) -> np.ndarray:
        nxt = np.minimum(at + 1, len(ids) - 1)
        inside = (nxt > at) & (word[nxt] == word[at])
        return np.where(inside, self.rank(ids[at], ids[nxt]), NO_RANK)

    def fold_long(self, word: bytes) -> list[int]:
        ids = self.bytes[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, i + 1, ids[i], ids[i + 1]) for i, r in enumerate(start) if r < NO_RANK]
        heapq.heapify(heap)
        def offer(i: int, j: int) -> None:
            r = int(self.rank(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r < NO_RANK:
                heapq.heappush(heap, (r, i, j, ids[i], ids[j]))
        while heap:
            rank, i, j, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] != j or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]


class Coder:
    """Encodes texts chunk by chunk with a bounded memory of the words met so far."""
    WORDS = 200_000        # distinct words remembered by a task at a time
    CHARS = 1_000_000      # characters of a chunk

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merger, self.split = Merger(ranks), regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.count, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, tokens: list[str]) -> None:
        if len(self.index) > self.WORDS:
            self._forget()
        fresh = [t for t in set(tokens) if t not in self.index]
        if fresh:
            ids, count = self.merger.fold([t.encode() for t in fresh])
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.flat = np.concatenate((self.flat, ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        found = [self.split.findall(t) for t in texts]
        tokens = list(itertools.chain.from_iterable(found))
        self._learn(tokens)
        at = np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        count = self.count[at]
        ends = np.concatenate(([0], np.cumsum(count)))
        bounds = np.concatenate(([0], np.cumsum([len(f) for f in found])))
        return _gather(self.flat, self.start[at], count), np.diff(ends[bounds])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, number of bytes of each text): the binary pieces, one after another."""
        size = self.merger.piece_len[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        return _gather(self.merger.pieces, self.merger.piece_start[ids], size), np.diff(ends[np.concatenate(([0], np.cumsum(count)))])

    def chunks(self, texts: list[str | None]) -> Iterator[pa.StructArray]:
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and (stop == start or held + len(texts[stop] or "") <= self.CHARS):
                held += len(texts[stop] or "")
                stop += 1
            ids, count = self.encode([t or "" for t in texts[start:stop]])
            data, size = self.decode(ids, count)
            offsets = lambda x: pa.array(np.concatenate(([0], np.cumsum(x))).astype(np.int32))
            binary = pa.BinaryArray.from_buffers(pa.binary(), stop - start, [None, offsets(size).buffers()[1], pa.py_buffer(data.tobytes())])
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets(count), pa.array(ids, pa.int32())), binary], ["ids", "decoded"])
            start = stop


def _gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices values[start : start + count], one after another."""
    ahead = np.cumsum(count) - count
    return values[np.repeat(start - ahead, count) + np.arange(int(count.sum()))]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """`docs` with `ids` and `decoded`. One pass over the texts, without a shuffle; the ranks are sent to the tasks once."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(sent.value, pattern)
        for batch in batches:
            yield pa.concat_arrays(list(coder.chunks(batch.to_pylist())) or [pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))])

    coded = docs.drop("ids", "decoded").withColumn("__llm_coded", code(whole("text")))
    return coded.select(*[c for c in docs.columns if c not in ("ids", "decoded")], F.col("__llm_coded.ids").alias("ids"), F.col("__llm_coded.decoded").alias("decoded"))
