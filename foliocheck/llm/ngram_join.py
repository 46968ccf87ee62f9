"""N-gram Jaccard join: documents whose sets of 5-word shingles overlap by 75 % or more, as connected components.

1. Texts with equal shingle sets form one class, found by a 128-bit digest of the sorted set.
2. Two sets that link share at least l tokens among the n - ceil(3n/4) + l smallest hashes of each, for any l; here l is an eighth of the
   smaller set. Only that part of each set is exchanged by token, where every token learns in how many sets it is; a token of one set alone
   can link nothing and stays behind.
3. The tokens of that part that are left get one global order, rare ones first. Of m of them, the first m - r + 1 are kept (r: the least l
   of any partner), so that linked sets still share one. Sets that share a kept token are tied by a star, and the components of those stars
   are the candidates: every link lies inside one of them.
4. A passage that many texts share ties their sets into one component, whose share of all sets grows with the corpus. A component of more
   than MANY sets is therefore cut by whole sets: all their tokens are counted and ranked, which ties sets only by tokens that are rare among
   all they have.
5. Each candidate component goes to one task, which joins its sets in a prefix tree (trie_join). A component too large for that is cut into
   blocks: blocks are joined alone, then the roots of what they found, then - only where several roots remain - every pair of blocks.

No stage emits the pairs of a group. Tokens found in very many sets are known beforehand from a table of 2 ** SLOT_BITS counters (fixed
size); they are spread by salt, where a count is needed take their counter's, and build their star from salted parts.

Defined cases: null text is empty; a document without words has no shingles, links with nothing and is its own component; fewer than five
words are one shingle; rows that repeat a text are one class; rows without an id link like all others, also where nobody in their class has
one, but never name a component, so component_id is null only where no row of it has an id; an empty table gives no rows. `link_documents`
returns its four columns alone, `dedup` the columns of its input.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliocheck.llm.common import ascii_lower, id_keys, let, one_of_each, shared_dir, whole, words
from foliocheck.llm.components import components
from foliocheck.llm.trie_join import join_block
from foliocheck.session import cut_lineage, ship_package

SIZE = 5
SLOT_BITS = 20
CHUNK = 4096           # counters per row of the counter table
HOT = 4096             # a counter of so many sets, and HOT_TIMES the mean of all counters, is hot
HOT_TIMES = 16
SALTS = 64
MANY = 256             # sets of a candidate component that are joined without a look at whole sets
BLOCK = 2_000_000      # shingles of a candidate component that one task holds


def shingles(text: Column) -> Column:
    """Distinct hashes of the shingles of a text."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - SIZE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SIZE)]))
    hashed = F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) >= SIZE, F.array_distinct(windows(h)))
               .when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))


def _part_size(n: Column) -> Column:
    """How many of the smallest hashes of a set of n are exchanged."""
    return n - F.floor((3 * n + 3) / 4).cast("int") + F.floor((n + 7) / 8).cast("int")


def _digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, the set's digest s1, s2, the hash h of the text, and the part of the set that is exchanged. The set is computed once per row."""
    row = let(F.sort_array(shingles(whole("text"))), lambda s: F.struct(
        F.size(s).cast("long").alias("n"), F.xxhash64(s).alias("s1"), F.xxhash64(F.lit(1), s).alias("s2"), F.slice(s, 1, _part_size(F.size(s))).alias("part")))
    return docs.select("doc_id", F.xxhash64(whole("text")).alias("h"), row.alias("row")).select("doc_id", "row.n", "row.s1", "row.s2", "h", "row.part")


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, offsets) of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of this task that are not zero."""
    counters = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for batch in batches:
        counters += np.bincount(_slots(_lists(batch.column("part"))[0]), minlength=len(counters))
    small = np.minimum(counters, 65535).astype(np.uint16).reshape(-1, CHUNK)
    rows = np.flatnonzero(small.any(axis=1))
    for start in range(0, len(rows), 64):
        part = rows[start:start + 64]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([small[r].tobytes() for r in part], pa.binary())], names=["chunk", "counts"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counter rows that this task owns as they stream by."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            part = np.frombuffer(counts.as_buffer(), dtype=np.uint16).astype(np.int64)
            total[chunk] = total[chunk] + part if chunk in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["chunk", "counts"])


def hot_counters(digests: DataFrame) -> np.ndarray:
    """The counters, zero where they are not hot: 2 ** SLOT_BITS numbers reach the driver and the tasks, whatever the corpus."""
    counts = digests.select("part").mapInArrow(_count, "chunk int, counts binary")
    total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for row in counts.repartition("chunk").mapInArrow(_total, "chunk int, counts binary").toLocalIterator():
        total[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, dtype=np.int64)
    return np.where(total >= max(HOT, HOT_TIMES * total.mean()), total, 0)


def _tokens(digests: DataFrame, hot) -> DataFrame:
    """(token, salt, node, n, heat) of the exchanged parts. Sets that a task has met before are left out."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("heat", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            values, offsets = _lists(batch.column("part"))
            nodes = batch.column("s1").to_pylist()
            fresh = np.array([not (x in seen or seen.add(x)) for x in nodes], dtype=bool)
            size = np.diff(offsets)
            chosen = np.repeat(fresh, size)
            node = np.repeat(batch.column("s1").to_numpy(), size)[chosen]
            token = values[chosen]
            heat = hot.value[_slots(token)]
            salt = np.where(heat > 0, 1 + node % SALTS, 0)
            columns = (token, salt, node, np.repeat(batch.column("n").to_numpy(), size)[chosen], heat)
            for start in range(0, len(token), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[start:start + 500_000], f.type) for c, f in zip(columns, schema)], schema=schema)

    return digests.select("s1", "n", "part").mapInArrow(emit, "token long, salt int, node long, n int, heat long")


def _kept(tokens: DataFrame) -> DataFrame:
    """(token, salt, node) of the tokens that candidates must share one of."""
    together = Window.partitionBy("token", "salt")
    counted = tokens.withColumns({"low": F.min("node").over(together), "high": F.max("node").over(together), "count": F.count("*").over(together)})
    shared = counted.filter((F.col("heat") > 0) | (F.col("low") != F.col("high")))
    shared = shared.select("token", "salt", "node", "n", F.when(F.col("heat") > 0, F.col("heat")).otherwise(F.col("count")).alias("df"))
    alone = Window.partitionBy("node")
    ranked = (shared.repartition("node").dropDuplicates(["node", "token"])
              .withColumns({"m": F.count("*").over(alone), "k": F.row_number().over(alone.orderBy("df", "token"))}))
    return ranked.filter(F.col("k") <= F.col("m") - F.floor((3 * F.col("n") + 31) / 32) + 1).select("token", "salt", "node")


def _stars(kept: DataFrame) -> DataFrame:
    """Edges (a, b) from each node to the smallest one that shares a token (and salt) with it; salted stars are tied together."""
    by_token = Window.partitionBy("token", "salt").orderBy("node")
    rows = kept.withColumn("least", F.first("node").over(by_token.rowsBetween(Window.unboundedPreceding, 0)))
    spokes = rows.filter(F.col("least") != F.col("node")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    hubs = kept.filter(F.col("salt") > 0).groupBy("token", "salt").agg(F.min("node").alias("node"))
    centre = hubs.groupBy("token").agg(F.min("node").alias("b"))
    ties = hubs.join(centre, "token").filter(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")
    return spokes.unionByName(ties).distinct()


def _cut_by_sets(sets: DataFrame) -> DataFrame:
    """(s1, comp) of the sets (s1, n, set) that can link, by components; each links only inside its own.

    A set that links shares at least three quarters of its tokens, so its smallest shared one is among the first floor(n / 4) + 1 of any common
    order. Rare tokens come first; those of one set alone are counted but tie nothing.
    """
    tokens = sets.select("s1", "n", F.explode("set").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("s1")
    ranked = tokens.join(shared, "token").withColumns({"alone": F.col("n") - F.count("*").over(own), "k": F.row_number().over(own.orderBy("df", "token"))})
    kept = cut_lineage(ranked.filter(F.col("alone") + F.col("k") <= F.floor(F.col("n") / 4) + 1).select("token", "s1"))
    least = kept.groupBy("token").agg(F.min("s1").alias("b"))
    edges = kept.join(least, "token").filter(F.col("s1") != F.col("b")).select(F.col("s1").alias("a"), "b")
    return components(edges).select(F.col("node").alias("s1"), F.col("label").alias("comp"))


def _joined(rows: DataFrame, key: list[str]) -> DataFrame:
    """Edges (a, b) from every class to the root of its component within its (key) block. `rows` has key columns, cid, known, set."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def block(cids: list[str], known: list[str | None], sets: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(sets)
        # Dense numbers in one order for the block, frequent tokens first.
        distinct, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
        place = np.empty(len(distinct), dtype=np.int64)
        place[np.argsort(-count, kind="stable")] = np.arange(len(distinct))
        dense = np.split(place[inverse], np.cumsum([len(s) for s in sets])[:-1])
        names = {}
        groups = None if known[0] is None else [names.setdefault(k, len(names)) for k in known]
        roots = join_block([np.sort(d).tolist() for d in dense], groups)
        return pa.RecordBatch.from_arrays([pa.array(cids, pa.string()), pa.array([cids[r] for r in roots], pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cids, known, sets = None, [], [], []
        for batch in batches:
            values, offsets = _lists(batch.column("set"))
            heads = zip(*(batch.column(k).to_pylist() for k in key))
            for i, (head, cid, group) in enumerate(zip(heads, batch.column("cid").to_pylist(), batch.column("known").to_pylist())):
                if head != current:
                    if cids:
                        yield block(cids, known, sets)
                    current, cids, known, sets = head, [], [], []
                cids.append(cid)
                known.append(group)
                sets.append(values[offsets[i]:offsets[i + 1]].copy())
        if cids:
            yield block(cids, known, sets)

    placed = rows.select(*key, "cid", "known", "set").repartition(*key).sortWithinPartitions(*key, "cid")
    return placed.mapInArrow(run, "a string, b string")


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """`members` with the set of each class, written once: texts are moved and cut into shingles a single time."""
    wanted = members.withColumnRenamed("s1", "want")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("min_doc")).select("text", *wanted.columns)
    # Classes in which no row has an id are found by the hash of a text; each task sends such a text once.
    nameless = docs.filter(F.col("doc_id").isNull()).groupBy(F.xxhash64(whole("text")).alias("__llm_hash")).agg(F.min("text").alias("text"))
    nameless = nameless.join(wanted.filter(F.col("min_doc").isNull()), F.col("__llm_hash") == F.col("min_hash")).select("text", *wanted.columns)
    row = let(F.sort_array(shingles(whole("text"))), lambda x: F.struct(F.xxhash64(x).alias("s1"), x.alias("set")))
    rows = texts.unionByName(nameless).withColumn("row", row).select(*[c for c in wanted.columns if c not in ("min_doc", "min_hash")], "row.s1", "row.set")
    # An id given to several texts brings other sets too. They go after the rows are written: else the test would become a key of the join above.
    return cut_lineage(rows).filter("want = s1").drop("want")


def _with_blocks(members: DataFrame, block: int) -> DataFrame:
    """`members` (comp, n, ...) with the classes of their component, how many blocks it needs and which one they are in."""
    load = members.groupBy("comp").agg(F.count("*").alias("classes"), F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    return members.join(load, "comp").withColumn("block", F.pmod(F.xxhash64("s1"), F.col("blocks")).cast("int"))


def _linked(docs: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(cid, label) of the classes in candidate components that may link. `members` has min_doc, min_hash, cid, s1, comp, n."""
    sets = _sets(docs, _with_blocks(members, block))
    wide = sets.filter(F.col("classes") > MANY)
    if not wide.isEmpty():
        finer = _cut_by_sets(wide.select("s1", "n", "set").dropDuplicates(["s1"]))
        finer = _with_blocks(finer.join(wide.select("s1", "n").distinct(), "s1"), block)
        sets = cut_lineage(sets.filter(F.col("classes") <= MANY).unionByName(wide.select("cid", "s1", "set").join(finer, "s1")))
    members = sets.drop("set")
    edges = cut_lineage(_joined(sets.withColumn("known", F.lit(None).cast("string")), ["comp", "block"]))
    roots = edges.select(F.col("a").alias("cid"), F.col("b").alias("label"))
    if members.filter("blocks > 1").isEmpty():
        return roots.distinct()
    # Components cut into blocks: their roots against each other, then what is still apart, block by block.
    cut = members.filter("blocks > 1").distinct()
    of_cut = sets.filter("blocks > 1").select("cid", "set")
    heads = cut.join(roots.filter(F.col("cid") == F.col("label")).select("cid").distinct(), "cid")
    heads = heads.withColumn("known", F.lit(None).cast("string")).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("blocks")).cast("int"))
    tied = edges.unionByName(_joined(of_cut.join(heads, "cid"), ["comp", "block"]))
    labels = cut_lineage(_labels(tied))
    apart = cut.join(labels.withColumnRenamed("label", "known"), "cid")
    several = apart.groupBy("comp").agg(F.countDistinct("known").alias("n_labels")).filter("n_labels > 1").select("comp")
    apart = apart.join(several, "comp")
    pairs = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter(F.col("other") != F.col("block"))
    pairs = pairs.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return _labels(labels.select(F.col("cid").alias("a"), F.col("label").alias("b")).unionByName(_joined(of_cut.join(pairs, "cid"), ["comp", "low", "high"])))


def _labels(edges: DataFrame) -> DataFrame:
    """(cid, label) of all nodes of the edges, those without a partner included."""
    alone = edges.select(F.col("a").alias("cid")).distinct()
    return alone.join(components(edges).withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("label", "cid").alias("label"))


def link_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`, and class_key, equal for equal shingle sets."""
    return _link_rows(docs, block).select("doc_id", "n_shingles", "component_id", "class_key")


def _link_rows(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`link_documents` with text_hash, and group: the class that its component is named by inside, null without shingles.

    Two components can have the same component_id, where an id is given to several texts; their groups differ.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = f"{shared_dir(spark)}/ngram-join-{uuid.uuid4().hex}"
    _digests(docs).write.parquet(path)
    digests = spark.read.schema("doc_id long, n long, s1 long, s2 long, h long, part array<long>").parquet(path)
    hot = spark.sparkContext.broadcast(hot_counters(digests))
    named = digests.select("doc_id", "n", "s1", "s2", "h").withColumn("cid", F.concat(F.hex("s1"), F.lit("-"), F.hex("s2")))
    classes = named.filter("n > 0").groupBy("cid", "s1", "n").agg(
        F.min("doc_id").alias("min_doc"), F.min(F.when(F.col("doc_id").isNull(), F.col("h"))).alias("min_hash"))
    candidates = components(_stars(_kept(_tokens(digests, hot)))).select(F.col("node").alias("s1"), F.col("label").alias("comp"))
    members = classes.join(candidates, "s1")
    labels = cut_lineage(_linked(docs, members, block))
    smallest = labels.join(classes.select("cid", "min_doc"), "cid").groupBy("label").agg(F.min("min_doc").alias("component"))
    resolved = classes.select("cid", "min_doc").join(labels.join(smallest, "label").select("cid", "label", "component"), "cid", "left")
    resolved = resolved.select("cid", F.coalesce("label", "cid").alias("group"), F.coalesce("component", "min_doc").alias("component"))
    found = named.join(resolved, "cid", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
                        F.col("cid").alias("class_key"), F.col("h").alias("text_hash"), "group")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each component: of those with the smallest doc_id, a null one only where there is no other, the one with the smallest text hash."""
    keys = ["__llm_no_id", "__llm_id", "__llm_h"]
    rows = _link_rows(docs).withColumns(id_keys()).withColumnRenamed("text_hash", "__llm_h")
    apart = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])      # a row without shingles is its own component
    keep = rows.groupBy(F.coalesce("group", apart)).agg(F.min(F.struct(*keys)).alias("keep")).select("keep.*")
    keyed = docs.withColumns({**id_keys(), "__llm_h": F.xxhash64(whole("text"))})
    return one_of_each(keyed, keys).join(keep, keys, "left_semi").select(docs.columns)
