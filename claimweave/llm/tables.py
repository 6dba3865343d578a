"""Reading the input tables, and helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave.session import importable_by_workers

#: White space that the text contracts name, as a character class for Java's regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; any store that Spark reads."""
    return importable_by_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def in_workers(rows: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``rows.mapInArrow`` of a function of this package, which is shipped to the workers first."""
    importable_by_workers(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def persist_cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage of ``frame`` in the shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that
    is unset (tests in local mode) a folder below the warehouse is named.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or f"{frame.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return frame.checkpoint()


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``frame`` has them."""
    taken = {c.lower() for c in frame.columns}
    longest = max(map(len, taken), default=0)
    return [n if n.lower() not in taken else "_" * longest + n for n in names]


def has_repeated_ids(frame: DataFrame, id_col: str) -> bool:
    """Whether any id, null included, occurs twice; reads that column only."""
    return not frame.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text: eight shifts a byte, by the reflected polynomial of the standard."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda a: ascii(a)::BIGINT)), lambda c, b: {bits}), 4294967295)"
