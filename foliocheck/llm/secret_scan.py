"""Secret scan with multipart credential linking.

A credential often comes in parts: an access identifier, a secret, an endpoint. Strong parts (the base patterns) are always reported. Weak
ones - an identifier or secret that alone would be noise, an endpoint - are reported only where complementary parts stand within SCOPE
characters of each other in the same text.

Spans come from one split and one extraction per pattern: the gaps and match lengths of a text give the offsets as running sums. The parts
are few next to the text; they are exploded, put into every bin (as wide as a scope) that they touch and joined bin by bin against the first
and last position of every part kind in a bin, so the work is linear in the matched characters however many parts one text holds and
however long they are. Texts are searched once and their parts written, since the link reads them three times; texts move only if the result keeps them.

Defined cases: null text is empty and has no spans; rows that repeat a document get the same result each; equal positions are ordered by
kind; an empty table gives no rows; other columns pass through, those named like an added column are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliocheck.llm.common import whole
from foliocheck.session import cut_lineage

SCOPE = 200


@dataclass(frozen=True)
class Part:
    """One pattern: what it is a part of, and how long a match (`group`) must be to be reported by itself or as a weak candidate.

    Every match holds one of the strings of `holds`, where any are given: a text without them need not be searched.
    """
    kind: str
    role: str
    pattern: str
    group: int = 0
    strong: int | None = None
    weak: int | None = None
    weak_kind: str = ""
    holds: tuple[str, ...] = ()


#: Kinds in the order in which equal positions are listed; the first three are the base patterns.
PARTS = [
    Part("assign", "secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, 4, "weak_assign", (":", "=")),
    Part("access", "identifier", r"AKIA[A-Z0-9]+", 0, 16, 10, "weak_access", ("AKIA",)),
    Part("hex", "secret", r"[0-9a-f]{20,}", 0, 32, 20, "weak_hex"),
    Part("login", "identifier", r"(?i:user(?:name)?|login|account|client_?id|access_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]+)", 1, None, 3, "weak_login", (":", "=")),
    Part("endpoint", "endpoint", r"(?i:https?|ftp|jdbc:[a-z]+|redis|mongodb|amqp|ssh)://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, None, 10, "endpoint", ("://",)),
]
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, *[p.weak_kind for p in PARTS]]


def _matches(text: Column, part: Part) -> Column:
    """(kind, number, gap before it, length, length of its group) of every match, reportable or not."""
    gaps = F.split(text, part.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(part.group))
    row = F.zip_with(F.zip_with(found, value, lambda m, v: F.struct(F.char_length(m).alias("m"), F.char_length(v).alias("v"))),
                     F.slice(gaps, 1, F.size(found)), lambda x, gap: F.struct(x["m"].alias("m"), x["v"].alias("v"), F.char_length(gap).alias("gap")))
    numbered = F.transform(row, lambda x, i: F.struct(F.lit(part.kind).alias("kind"), i.alias("k"), x["gap"].alias("gap"), x["m"].alias("len"), x["v"].alias("value_len")))
    there = reduce(or_, [F.contains(text, F.lit(s)) for s in part.holds], F.lit(not part.holds))
    return F.when(there & text.rlike(part.pattern), numbered)


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, role, start, end (code points, end exclusive), strong: one row per strong or weak part."""
    text = whole("text")
    empty = F.array().cast("array<struct<kind:string,k:int,gap:int,len:int,value_len:int>>")
    # An outer explode, since a test for empty lists, also the one that Spark adds below an inner one, would search every text a second time.
    found = (docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.concat(*[F.coalesce(_matches(text, p), empty) for p in PARTS]).alias("m"))
             .select("doc_id", "text_hash", F.explode_outer("m").alias("m")).filter("m IS NOT NULL").select("doc_id", "text_hash", "m.*")
             .dropDuplicates(["doc_id", "text_hash", "kind", "k"]))
    order = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("k")
    end = F.sum(F.col("gap") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    role, strong, weak, weak_kind = (F.create_map(*[F.lit(x) for p in PARTS for x in (p.kind, v(p))]) for v in (
        lambda p: p.role, lambda p: p.strong or 1 << 30, lambda p: p.weak, lambda p: p.weak_kind))
    rows = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).withColumn("strong", F.col("value_len") >= strong[F.col("kind")])
    return (rows.filter(F.col("strong") | (F.col("value_len") >= weak[F.col("kind")]))
            .select("doc_id", "text_hash", F.when(F.col("strong"), F.col("kind")).otherwise(weak_kind[F.col("kind")]).alias("kind"),
                    role[F.col("kind")].alias("role"), "start", "end", "strong"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`found` without the weak parts that have no complementary part within `scope`.

    A weak identifier needs a secret, a weak secret an identifier or an endpoint, an endpoint an identifier and a secret.
    """
    doc = ["doc_id", "text_hash"]
    def bins(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(*[F.floor(at / scope).cast("long") for at in (first, last)]))
    # Two parts of one bin are less than a scope apart, so its first start and last end are near a third part only if one of its parts is.
    summary = (found.select(*doc, "role", "start", "end", bins(F.col("start"), F.col("end") - 1).alias("bin"))
               .groupBy(*doc, "bin", "role").agg(F.min("start").alias("first"), F.max("end").alias("last")))
    reach = bins(F.col("start") - scope - 1, F.col("end") + scope)
    near = (found.filter(~F.col("strong")).select(*doc, "kind", "role", "start", "end", reach.alias("near_bin")).alias("w")
            .join(summary.alias("s"), (F.col("w.doc_id").eqNullSafe(F.col("s.doc_id"))) & (F.col("w.text_hash") == F.col("s.text_hash"))
                  & (F.col("w.near_bin") == F.col("s.bin")) & (F.col("w.role") != F.col("s.role"))
                  & (F.col("s.first") <= F.col("w.end") + scope) & (F.col("s.last") >= F.col("w.start") - scope)))
    has = {role: F.max((F.col("s.role") == role).cast("int")) for role in ("identifier", "secret", "endpoint")}
    linked = near.groupBy(*[f"w.{c}" for c in (*doc, "kind", "role", "start", "end")]).agg(*[v.alias(f"near_{k}") for k, v in has.items()])
    enough = (F.when(F.col("role") == "identifier", F.col("near_secret") == 1)
              .when(F.col("role") == "secret", (F.col("near_identifier") == 1) | (F.col("near_endpoint") == 1))
              .otherwise((F.col("near_identifier") == 1) & (F.col("near_secret") == 1)))
    columns = [*doc, "kind", "start", "end"]
    return found.filter("strong").select(*columns).unionByName(linked.filter(enough).select(*columns))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`docs` with n_assign, n_access, n_hex and `secrets`: an array of (start, kind_order, kind, end) in text order."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    spans = (link(cut_lineage(parts(docs)), scope).groupBy(F.col("doc_id").alias("__llm_doc"), F.col("text_hash").alias("__llm_hash"))
             .agg(F.sort_array(F.collect_list(F.struct("start", rank[F.col("kind")].alias("kind_order"), "kind", "end"))).alias("secrets")))
    added = ["secrets", *[f"n_{k}" for k in BASE]]
    # The hash is taken before the join: as a part of its condition it would move every text.
    hashed = docs.drop(*added).withColumn("__llm_key", F.xxhash64(whole("text")))
    joined = hashed.join(spans, F.col("doc_id").eqNullSafe(F.col("__llm_doc")) & (F.col("__llm_key") == F.col("__llm_hash")), "left").drop("__llm_key")
    none = F.array().cast("array<struct<start:bigint,kind_order:int,kind:string,end:bigint>>")
    joined = joined.withColumn("secrets", F.coalesce("secrets", none)).drop("__llm_doc", "__llm_hash")
    return joined.withColumns({f"n_{k}": _count(k) for k in BASE})


def _count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda span: span["kind"] == kind)).cast("long")


def written(secrets: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = F.filter(secrets, lambda s: s["kind"].isin(kinds)) if kinds else secrets
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every reported span replaced by `mark`; spans that overlap become one."""
    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))
    found = scan(docs)
    state = F.aggregate("secrets", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), step)
    rest = F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.lit(2147483647)))
    return found.withColumn("text", F.when(F.size("secrets") == 0, F.col("text")).otherwise(rest))
