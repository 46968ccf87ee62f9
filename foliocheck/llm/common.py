"""Column helpers that several operators share."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank characters of all contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once per row.

    An expression that a lambda mentions is evaluated again for each element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: str | Column) -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """Runs of characters that are not blank, in order; an empty array if there are none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of `keys`, the same in every run. Each task sends a value once, so a row that is found everywhere gathers nowhere."""
    rest = [c for c in rows.columns if c not in keys]
    hashable = [c for c, kind in rows.dtypes if c in rest and "map<" not in kind]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.xxhash64(*hashable)).alias("__llm_row")).select(*keys, "__llm_row.*")


def id_keys(doc_id: str = "doc_id") -> dict[str, Column]:
    """Key columns under which null ids meet as equals in a plain join."""
    return {"__llm_id": F.coalesce(F.col(doc_id), F.lit(0)), "__llm_no_id": F.col(doc_id).isNull()}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a session without that setting (a test) gets a temporary one of its own.
    """
    from foliocheck.session import checkpoint_dir
    return checkpoint_dir(spark)
