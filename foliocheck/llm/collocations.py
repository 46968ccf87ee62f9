"""Phrases whose words keep together, mined by set-oriented joins over occurrence relations.

The relation of length k holds every place where a frequent phrase of k words starts, sorted by text, piece and position, and is written to the
shared folder. Length k + 1 comes from a merge join of the relation with itself on piece and adjacent position: two frequent phrases one word
apart are one phrase of a word more. Its phrases are counted by groups, and the new relation is the semi-join with the groups that are frequent.

Layout. Occurrences stay where their texts were read: a row of a relation is a block of about BLOCK_BYTES of text of one language, its sorted
positions and local phrase numbers packed as columns (`_pack`); the merge join runs inside blocks as array operations. What moves is one entry per
(block, phrase) with a count: to the groups by phrase, and the frequent ones back to their blocks by a cogroup. So a word that is found
everywhere makes one entry per block, nothing is broadcast, and a task holds one block at a time. Entries of joined phrases travel as lists, one per
block and bucket of first parts; a first part found more than LANE times is dealt to several buckets by the second. Phrases are named by the block and number of
one of their occurrences (`gid`), not by hashes: counts are exact. A frequent phrase carries the counts of all its first and last parts, handed
on from the phrases it is joined from, so that scores need no further look-up.

Defined cases: null text is empty; null language is `und`; a piece ends at PIECE_END and at the end of its text; rows that repeat an id count each
for itself; no frequent phrase or an empty table gives no rows; columns other than text and lang are not read.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliocheck.llm.common import shared_dir
from foliocheck.session import ship_package

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
PIECE_END = "[.,;:!?\n-\r]+"
BLOCK_BYTES = 8 << 20
#: A gid is partition, block of the partition and local number in one long.
_BLOCK_BITS, _LOCAL_BITS = 18, 25
_LANES = 64
LANE = 1 << 20
BUCKETS = 1 << 13

_FIRST = "block bigint, lang string, pos binary, ids binary, words array<string>, counts array<bigint>"
_RELATION = ("block bigint, lang string, pos binary, ids binary, gid array<bigint>, f array<bigint>, "
             "named array<struct<gid:bigint,f:bigint,a:bigint,b:bigint,word:string>>")
#: Both halves of the parts' names travel apart: the upper ones hardly differ inside a list, so they compress to almost nothing.
_PAIRS = "block bigint, lang string, bucket bigint, start bigint, a_high array<int>, a_low array<int>, b_high array<int>, b_low array<int>, counts array<int>"
_NAMED = pa.struct([(c, pa.int64()) for c in ("gid", "f", "a", "b")] + [("word", pa.string())])


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _block(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray] | None:
    """(positions, local word numbers, the words, their counts) of some texts; a break between pieces takes a position of its own."""
    lower = pc.binary_join_element_wise(pc.ascii_lower(pc.fill_null(text, "")), "\n", "")
    split = pc.split_pattern_regex(pc.replace_substring_regex(lower, PIECE_END, " \n "), "[ \t]+").flatten().dictionary_encode()
    codes, names = split.indices.to_numpy(), split.dictionary
    blank, end = (pc.index(names, v).as_py() for v in ("", "\n"))
    codes = codes[codes != blank]
    pos = np.flatnonzero(codes != end)
    if not len(pos):
        return None
    counts = np.bincount(codes[pos], minlength=len(names))
    used = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
    local = np.empty(len(names), np.int64)
    local[used] = np.arange(len(used))
    return pos, local[codes[pos]], names.take(pa.array(used)), counts[used]


def _tokenize(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    task, n_blocks = TaskContext.get().partitionId(), 0
    for batch in batches:
        langs = pc.fill_null(batch.column("lang"), "und")
        for lang in langs.unique():
            text = batch.column("text").filter(pc.equal(langs, lang))
            share = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(), dtype=np.int64) // block_bytes
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(share)) + 1, [len(text)]]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                made = _block(text.slice(a, b - a))
                if made is None:
                    continue
                pos, ids, words, counts = made
                if n_blocks >> _BLOCK_BITS or len(words) >> _LOCAL_BITS:
                    raise ValueError("a partition has too many blocks, or a block too many words, to be named by a long")
                yield pa.RecordBatch.from_arrays([pa.array([(task << _BLOCK_BITS) + n_blocks], pa.int64()), pa.array([lang.as_py()], pa.string()), pa.array([_pack(np.diff(pos, prepend=0))]),
                                                  pa.array([_pack(ids)]), pa.ListArray.from_arrays([0, len(words)], words), pa.array([counts.tolist()], pa.list_(pa.int64()))],
                                                 ["block", "lang", "pos", "ids", "words", "counts"])
                n_blocks += 1


def _mixed(numbers: np.ndarray) -> np.ndarray:
    return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _adjacent(pos: np.ndarray, ids: np.ndarray, gid: np.ndarray, f: np.ndarray, lane: int) -> tuple[np.ndarray, ...]:
    """Merge join of a sorted relation with itself one position on: (positions, local numbers of the joined phrases; bucket, first part, second part and
    count of each phrase). Phrases are numbered by bucket, first part and second part."""
    here = np.flatnonzero(np.diff(pos) == 1)
    width = len(gid) or 1
    pairs, numbers, counts = np.unique(ids[here] * width + ids[here + 1], return_inverse=True, return_counts=True)
    first, second = pairs // width, pairs % width
    bucket = _mixed(gid[first] + _mixed(gid[second]) % (1 + f[first] // lane)) % BUCKETS
    order = np.lexsort((second, first, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return pos[here], place[numbers], bucket[order], gid[first[order]], gid[second[order]], counts[order]


def _relation(rows: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, ...]:
    """(positions, local numbers, gid and count of each local number) of a block."""
    return (np.cumsum(_unpack(rows.column("pos")[i].as_py())), _unpack(rows.column("ids")[i].as_py()),
            rows.column("gid")[i].values.to_numpy(), rows.column("f")[i].values.to_numpy())


def _halves(gid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (gid >> 32).astype(np.int32), (gid & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def _whole_gid(name: str) -> Column:
    return F.shiftleft(F.col(f"w.{name}_high").cast("long"), 32) + F.col(f"w.{name}_low").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def _pairs(batches: Iterator[pa.RecordBatch], lane_size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            _, _, bucket, first, second, counts = _adjacent(*_relation(batch, i), lane_size)
            head = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.concatenate([head, [len(bucket)]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("block")[i], len(head)), pa.repeat(batch.column("lang")[i], len(head)), pa.array(bucket[head]), pa.array(head),
                                              *[pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (*_halves(first), *_halves(second), counts)]],
                                             ["block", "lang", "bucket", "start", "a_high", "a_low", "b_high", "b_low", "counts"])


def _semi_join(block: int, lang: str, pos: np.ndarray, numbers: np.ndarray, frequent: pa.Table, parts: tuple[np.ndarray, np.ndarray] | None, words: pa.Array | None) -> pa.Table:
    """The rows of a block's relation whose phrase is among the frequent ones. `named` lists the phrases that this block names, with the parts or the
    word they are made of."""
    frequent = frequent.sort_by("local")
    local, gid, f = (frequent.column(c).to_numpy() for c in ("local", "gid", "f"))
    new = np.full(int(numbers.max()) + 1, -1, np.int64)
    new[local] = np.arange(len(local))
    kept = new[numbers] >= 0
    own = gid == (block << _LOCAL_BITS) + local
    made_of = [pa.array(p[local[own]]) if parts else pa.nulls(int(own.sum()), pa.int64()) for p in (parts or (0, 0))]
    word = words.take(pa.array(local[own])) if words is not None else pa.nulls(int(own.sum()), pa.string())
    named = pa.StructArray.from_arrays([pa.array(gid[own]), pa.array(f[own]), *made_of, word], fields=list(_NAMED))
    def listed(v):
        return pa.ListArray.from_arrays([0, len(v)], v)
    return pa.table({"block": pa.array([block], pa.int64()), "lang": pa.array([lang], pa.string()), "pos": pa.array([_pack(np.diff(pos[kept], prepend=0))]), "ids": pa.array([_pack(new[numbers][kept])]),
                     "gid": listed(pa.array(gid)), "f": listed(pa.array(f)), "named": listed(named)})


_NONE = pa.table({c: pa.array([], t) for c, t in (("block", pa.int64()), ("lang", pa.string()), ("pos", pa.binary()), ("ids", pa.binary()), ("gid", pa.list_(pa.int64())), ("f", pa.list_(pa.int64())),
                                                  ("named", pa.list_(_NAMED)))})


def _keep_words(rows: pa.Table, frequent: pa.Table) -> pa.Table:
    if not rows.num_rows or not frequent.num_rows:
        return _NONE
    pos, ids = np.cumsum(_unpack(rows.column("pos")[0].as_py())), _unpack(rows.column("ids")[0].as_py())
    return _semi_join(rows.column("block")[0].as_py(), rows.column("lang")[0].as_py(), pos, ids, frequent, None, rows.column("words")[0].values)


def _keep_phrases(rows: pa.Table, frequent: pa.Table, lane_size: int) -> pa.Table:
    if not rows.num_rows or not frequent.num_rows:
        return _NONE
    pos, numbers, _, first, second, _ = _adjacent(*_relation(rows, 0), lane_size)
    return _semi_join(rows.column("block")[0].as_py(), rows.column("lang")[0].as_py(), pos, numbers, frequent, (first, second), None)


def _keeping(lane: int):
    def keep(rows: pa.Table, frequent: pa.Table) -> pa.Table:
        return _keep_phrases(rows, frequent, lane)
    return keep


def _frequent(counted: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    """(block, local, gid, f) of the rows (gid of their own, keys, n) whose group reaches `min_count`."""
    group = Window.partitionBy(*keys)
    found = counted.withColumns({"f": F.sum("n").over(group), "gid": F.min("own").over(group)}).filter(F.col("f") >= min_count)
    return found.select(F.shiftright("own", _LOCAL_BITS).alias("block"), F.col("own").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("local"), "gid", "f")


def _own() -> Column:
    return (F.shiftleft("block", _LOCAL_BITS) + F.col("i")).alias("own")


def _named(relation: DataFrame) -> DataFrame:
    """One row per frequent phrase of a relation: gid, lang, f, and the parts or the word that make it up."""
    return relation.select("lang", F.explode("named").alias("p")).select("lang", "p.*")


def _longer(named: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases (gid, lang, phrase, f, heads, tails, a, b) from those one word shorter that they join; heads and tails are the counts of their first
    and last 1, 2, ... words."""
    head, tail = shorter.select(F.col("gid").alias("a"), F.col("phrase").alias("front"), "heads"), shorter.select(F.col("gid").alias("b"), F.col("phrase").alias("back"), "tails")
    return named.join(head, "a").join(tail, "b").select(
        "gid", "lang", F.concat_ws(" ", F.substring_index("front", " ", 1), "back").alias("phrase"), "f",
        F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"), "a", "b")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, block_bytes: int = BLOCK_BYTES,
                     lane: int = LANE) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n) with all words counted; per length the phrases found `min_count` times or more as gid, lang, phrase, f, heads, tails, a, b)."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = f"{shared_dir(spark)}/collocations-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    tokens = kept(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(partial(_tokenize, block_bytes=block_bytes), _FIRST), "words")
    sizes = tokens.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    counted = tokens.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w")).select(_own(), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    found = _frequent(counted, ["lang", "word"], min_count)
    relation = kept(tokens.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_keep_words, _RELATION), "1")
    levels = [kept(_named(relation).select("gid", "lang", F.col("word").alias("phrase"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"), "a", "b"), "phrases1")]
    for k in range(2, max_words + 1):
        # The lists move and are opened behind the exchange, where their buckets already lie together.
        lists = relation.mapInArrow(partial(_pairs, lane_size=lane), _PAIRS).repartition("bucket")
        counted = (lists.select("block", "lang", "bucket", "start", F.posexplode(F.arrays_zip("a_high", "a_low", "b_high", "b_low", "counts")).alias("j", "w"))
                   .withColumn("i", F.col("start") + F.col("j")).select(_own(), "lang", "bucket", _whole_gid("a").alias("a"), _whole_gid("b").alias("b"), F.col("w.counts").cast("long").alias("n")))
        if k == max_words:      # no longer phrase needs its occurrences
            named = counted.groupBy("lang", "bucket", "a", "b").agg(F.sum("n").alias("f"), F.min("own").alias("gid")).filter(F.col("f") >= min_count)
        else:
            found = _frequent(counted.drop("lang"), ["bucket", "a", "b"], min_count)
            relation = kept(relation.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_keeping(lane), _RELATION), str(k))
            named = _named(relation)
        levels.append(kept(_longer(named, levels[-1]), f"phrases{k}"))
    return sizes, levels


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, block_bytes: int = BLOCK_BYTES, lane: int = LANE) -> DataFrame:
    """Per language the `top` phrases of 2 to `max_words` words by score: lang, rank, phrase, a (its count), l, r (counts of the parts of its weakest
    cut), n (all words), score. A phrase that a longer one contains each time it occurs is left to that one."""
    sizes, levels = frequent_phrases(docs, min_count, max_words, block_bytes, lane)
    candidates = None
    for phrases, longer in zip(levels[1:], [*levels[2:], None]):
        if longer is not None:
            # Counts fall as phrases grow, so the phrases one word longer decide for all longer ones.
            inside = longer.select(F.explode(F.array("a", "b")).alias("gid"), "f").groupBy("gid").agg(F.max("f").alias("held"))
            phrases = phrases.join(inside, "gid", "left").filter(F.coalesce("held", F.lit(0)) < F.col("f")).drop("held")
        phrases = phrases.select("lang", "phrase", "f", "heads", "tails")
        candidates = phrases if candidates is None else candidates.unionByName(phrases)
    whole_number = "decimal(38,0)"
    cut = F.expr(f"""array_min(transform(sequence(1, size(heads) - 1), k -> named_struct('score',
        (cast(f as {whole_number}) * cast(n as {whole_number}) * 1000) div (cast(heads[k - 1] as {whole_number}) * cast(tails[size(tails) - k - 1] as {whole_number})),
        'k', k, 'l', heads[k - 1], 'r', tails[size(tails) - k - 1])))""")
    scored = candidates.join(sizes, "lang").withColumn("cut", cut).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each lane of a language passes on what could be among its first, so a language that has most candidates is not ranked by one task.
    lane = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_LANES))).orderBy(*order))
    short = scored.withColumn("place", lane).filter(F.col("place") <= top).drop("place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return short.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
