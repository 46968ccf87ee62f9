"""Exact dedup over an extendible-hash index on shared files.

The pseudo-key of a text is a 64-bit hash. A directory maps key prefixes to buckets: it doubles as long as a bucket holds more entries than
its capacity, and only the overfull buckets split. Buckets are dealt to owner tasks as ranges of keys; each owner chains the texts that
share a key and compares their bytes. What it finds - one entry per distinct text - is the index, stored by bucket in the shared folder.
Documents then look their entry up by key.

Before they move, the texts of each map task are chained in the same way, so that a text found in a third of all rows reaches its owner
once per task. A bucket that one key overfills cannot split further; it stays and its chain simply grows by distinct texts.

Defined cases: null text counts as empty; the largest doc_id of a group stays, a null id only where there is no other; rows that repeat a
doc_id are group members each, and one of them stays; an empty table gives no rows; other columns pass through, those named like an added
column are replaced.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliocheck.llm.common import id_keys, one_of_each, shared_dir, whole
from foliocheck.session import ship_package

CAPACITY = 4096        # entries per bucket
MAX_DEPTH = 18         # the directory has at most 2 ** MAX_DEPTH prefixes, whatever the number of documents

_SLOT = "bucket int, h long, text string, keep_id long, n long"
_ENTRY = "bucket int, h long, chain int, keep_id long, group_size long, text_sha256 string"


def directory(load: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """(global depth, bucket of each prefix of that many bits) for the number of keys under each prefix of `max_depth` bits.

    Starts with one bucket of depth 0. While some bucket is over capacity, it splits on its next bit; the directory doubles when that
    bit is beyond its depth. A bucket is named by its first prefix, so buckets are ranges of keys in order.
    """
    prefixes = sorted(load)
    depth, done, open_buckets = 0, [], [(0, 0, prefixes)]      # (local depth, leading bits, keys' prefixes)
    while open_buckets:
        local, bits, inside = open_buckets.pop()
        if local == max_depth or sum(load[p] for p in inside) <= capacity:
            done.append((local, bits))
            continue
        depth = max(depth, local + 1)
        shift = max_depth - local - 1
        ones = [p for p in inside if p >> shift & 1]
        zeros = [p for p in inside if not p >> shift & 1]
        open_buckets += [(local + 1, bits << 1, zeros), (local + 1, bits << 1 | 1, ones)]
    owner = [0] * (1 << depth)
    for local, bits in done:
        first = bits << (depth - local)
        for prefix in range(first, first + (1 << (depth - local))):
            owner[prefix] = first
    return depth, owner


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth).cast("int") if depth else F.lit(0)


def chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (bucket, h, text, keep_id, n) sorted by key -> the same with one row per distinct text of a key, and its place in the chain."""
    key, chain = None, []
    for bucket, h, text, keep_id, n in rows:
        if (bucket, h) != key:
            yield from ((*key, i, *slot) for i, slot in enumerate(chain))
            key, chain = (bucket, h), []
        for slot in chain:
            if slot[0] == text:
                slot[1] = max((x for x in (slot[1], keep_id) if x is not None), default=None)
                slot[2] += n
                break
        else:
            chain.append([text, keep_id, n])
    if key:
        yield from ((*key, i, *slot) for i, slot in enumerate(chain))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batched(rows: Iterator[tuple], schema: pa.Schema, most_chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; the third column may be a long text."""
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += 100 + (len(row[2]) if isinstance(row[2], str) else 0)
        if chars > most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: one row per distinct text of this task."""
    schema = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("text", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])
    yield from _batched(((bucket, h, text, keep, n) for bucket, h, _, text, keep, n in chained(_rows(batches))), schema)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner side: one entry per distinct text of this task's key ranges."""
    schema = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("chain", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
    yield from _batched(((bucket, h, i, keep, n, hashlib.sha256(text.encode()).hexdigest()) for bucket, h, i, text, keep, n in chained(_rows(batches))), schema)


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """bucket, h, chain, keep_id, group_size, text_sha256 of every distinct text, written to the shared folder and read from there."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.xxhash64(whole("text")).alias("h"), whole("text").alias("text"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    # At most 2 ** max_depth counts come to the driver.
    fine = texts.groupBy(_prefix(F.col("h"), max_depth).alias("prefix")).agg(F.count("*").alias("n"))
    depth, owner = directory({row.prefix: row.n for row in fine.toLocalIterator()}, capacity, max_depth)
    table = spark.createDataFrame(list(enumerate(owner)), "prefix int, bucket int")
    placed = (texts.withColumn("prefix", _prefix(F.col("h"), depth)).join(F.broadcast(table), "prefix").select("bucket", "h", "text", "keep_id", "n"))
    combined = placed.sortWithinPartitions("bucket", "h").mapInArrow(_combine, _SLOT)
    owned = combined.repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(_own, _ENTRY)
    path = f"{shared_dir(spark)}/exact-index-{uuid.uuid4().hex}"
    owned.write.parquet(path)
    return spark.read.schema(_ENTRY).parquet(path)


def members(docs: DataFrame, index: DataFrame) -> DataFrame:
    """`docs` with keep_id, group_size, kept and text_sha256, looked up by key. A hot key is split among tasks by the adaptive join."""
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    keyed = docs.drop(*added).withColumn("__llm_h", F.xxhash64(whole("text"))).withColumn("text_sha256", F.sha2(whole("text"), 256))
    found = keyed.join(index.select(F.col("h").alias("__llm_h"), "text_sha256", "keep_id", "group_size"), ["__llm_h", "text_sha256"])
    return found.select(*[c for c in docs.columns if c not in added], "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of each group: of the rows with the id that an entry keeps, the one that `one_of_each` takes. No group ever meets in one task."""
    keys = ["__llm_id", "__llm_no_id", "__llm_h", "__llm_sha"]
    stays = build_index(docs, capacity).withColumns(id_keys("keep_id")).select(*keys[:2], F.col("h").alias(keys[2]), F.col("text_sha256").alias(keys[3]))
    keyed = docs.withColumns({**id_keys(), "__llm_h": F.xxhash64(whole("text")), "__llm_sha": F.sha2(whole("text"), 256)})
    return one_of_each(keyed, keys).join(stays, keys, "left_semi").select(docs.columns)
