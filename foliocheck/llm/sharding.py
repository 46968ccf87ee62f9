"""Shards drawn down a tree of regions, racks and shards.

Every node of the tree weighs what the shards below it weigh. A row starts at the root; at each level every child draws a number from the hash of
(child, key), divided by its weight (the exponential race of weighted rendezvous hashing), and the row descends into the winner. A child's draw
depends on nothing but itself, so a changed weight moves rows only into or out of the subtrees whose weights changed: between racks of a
region whose total stays, nothing leaves the region. `grow` adds a shard in a region of its own, which raises no other weight; then rows move
into the new shard alone.

The law is `key`: the id and the tree decide. Counts and bytes of shards are even as far as hashing makes them; equal texts under different
ids are placed each for itself. Inside its shard a row has a slot: the position in a fixed shuffled order. Slots are read off a sorted table
(rows before it in its file, plus the counts of the files before), so that no task numbers a whole shard, and one id that makes up a third of
the rows is spread over the ranges like any other rows.

Defined cases: null text has no bytes (size 1) and the checksum of the empty text; rows without an id are keyed by the digest of their text;
rows that repeat id and text share the shard and get slots of their own, in any order among themselves; an empty table gives no rows; other
columns pass through, those named like an added column are replaced. A weight of zero takes no rows.
"""
from __future__ import annotations

import uuid
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliocheck.llm.common import let, shared_dir, whole

SEED = "shards"
ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
#: Hex digits of a draw: 52 bits, which a double holds exactly.
_DIGITS, _RANGE = 13, float(1 << 52)


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(n_shards: int = 8, at_first: int = 8, per_rack: int = 2, per_region: int = 4) -> list[Shard]:
    """Shards 0 to n - 1: those built at first fill racks and regions, each later one opens a region."""
    first = [Shard(f"r{i // per_region}", f"k{i // per_rack}", i) for i in range(min(n_shards, at_first))]
    return first + [Shard(f"g{i}", f"k{i}", i) for i in range(at_first, n_shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own."""
    new = max(s.shard for s in tree) + 1
    return [*tree, Shard(f"g{new}", f"k{new}", new, weight)]


def children(tree: list[Shard]) -> dict[str, dict[str, float]]:
    """Node -> its children with their weights; a node is named by its path from the root."""
    if len({s.shard for s in tree}) < len(tree) or any(s.weight < 0 for s in tree) or not any(s.weight for s in tree):
        raise ValueError("shards must differ, and weights be positive")
    out: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for s in tree:
        rack = f"{s.region}/{s.rack}"
        for parent, child in (("", s.region), (s.region, rack), (rack, f"{rack}/{s.shard}")):
            if s.weight:
                out[parent][child] += s.weight
    return out


def draw(name: str | Column, key: Column) -> Column:
    """A number strictly between 0 and 1 from (name, key)."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.lit(name) if isinstance(name, str) else name, key).cast("binary"))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / F.lit(_RANGE)


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard that the key descends to."""
    nodes = children(tree)
    table = F.create_map(*[x for parent, below in nodes.items() for x in (
        F.lit(parent), F.array(*[F.struct(F.lit(child).alias("child"), F.lit(weight).alias("weight")) for child, weight in sorted(below.items())]))])
    numbers = F.create_map(*[x for s in tree for x in (F.lit(f"{s.region}/{s.rack}/{s.shard}"), F.lit(s.shard))])

    def down(path: Column) -> Column:
        races = F.transform(F.element_at(table, path), lambda c: F.struct((F.ln(draw(c["child"], key)) / c["weight"]).alias("drawn"), c["child"].alias("child")))
        return F.array_max(races)["child"]

    return F.element_at(numbers, down(down(down(F.lit("")))))


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(whole(text).cast("binary"))))


def place(docs: DataFrame, tree: list[Shard] | None = None, grown: list[Shard] | None = None) -> DataFrame:
    """`docs` with size, text_crc32, law, shard and the shard under the grown tree, and the turn that orders a shard. Nothing is shuffled."""
    tree = tree or layout()
    grown = grown or grow(tree)
    body = whole("text").cast("binary")
    kept = [c for c in docs.columns if c not in ADDED]
    return docs.select(*kept, (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
                       let(key_of(), lambda key: F.struct(shard_of(key, tree).alias("shard"), shard_of(key, grown).alias("grown"),
                                                          draw("slot", key).alias("turn"))).alias("__llm_at")) \
        .select(*kept, "size", "text_crc32", "law", F.col("__llm_at.shard").alias("shard"), F.col("__llm_at.grown").alias("grown_shard"),
                F.col("__llm_at.turn").alias("__llm_turn"))


def number(placed: DataFrame) -> DataFrame:
    """`placed` with `slot`, gapless from 0 in each shard.

    The rows go through one sort: leave out what need not move (a query over texts passes ids and digests only).
    """
    spark = placed.sparkSession
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    order = ["shard", "__llm_turn", "doc_id", "size", "text_crc32"]
    # The tag only parts rows that are equal in all of these, so that a range can end among them.
    ranged = placed.withColumn("__llm_tag", F.monotonically_increasing_id()).repartitionByRange(*order, "__llm_tag").sortWithinPartitions(*order)
    ranged.drop("__llm_tag").write.parquet(folder)
    rows = spark.read.schema(placed.schema).parquet(folder).select("*", F.col("_metadata.file_path").alias("__llm_file"), F.col("_metadata.row_index").alias("__llm_row"))
    place_in_file = F.struct(*order)
    # One row per file and per shard that it touches; files follow each other by their first and last rows.
    parts = (rows.groupBy("__llm_file", "shard").agg(F.min("__llm_row").alias("__llm_first"), F.count("*").alias("n"),
                                                    F.min(place_in_file).alias("low"), F.max(place_in_file).alias("high")))
    before = Window.partitionBy("shard").orderBy("low", "high", "__llm_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("__llm_file", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("__llm_first")).alias("__llm_start"))
    return rows.join(starts, ["__llm_file", "shard"]).select(
        *[c for c in placed.columns if c not in ("grown_shard", "__llm_turn")], (F.col("__llm_start") + F.col("__llm_row")).alias("slot"), "grown_shard")


def assign(docs: DataFrame, tree: list[Shard] | None = None, grown: list[Shard] | None = None) -> DataFrame:
    """All columns of `docs`, with shard and slot."""
    return number(place(docs, tree, grown))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, tree: list[Shard] | None = None) -> None:
    """One folder `shard=N` per shard. Rows are written where they are, as one file per task and shard: no shard gathers in one task."""
    place(docs, tree).drop("grown_shard", "__llm_turn").write.partitionBy("shard").parquet(path)
