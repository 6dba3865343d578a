"""Exact dedup by progressive refinement (native).

Rows are grouped by the length of their normalised text; rows whose length
is shared go on to a hash of a short prefix; rows that share both have
their full content hashed. Refinements work on narrow rows and join
pre-aggregated group tables, so that a group with a third of all rows is
counted map-side and AQE may split its join. ``classify`` returns the hash
of every row, so there the last step hashes all of them where they are
read; ``drop_duplicates`` fetches and hashes the surviving texts alone.

Defined cases: a null or empty text is the empty text, and all of those
are one group. A null id sorts after every other id. Rows that repeat the
kept row's id and length are all marked ``kept``; ``drop_duplicates``
leaves exactly one of them. Columns of the input that clash with the
result's are not read; ``drop_duplicates`` returns the input's columns
unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.tables import SPACE_CLASS, has_repeated_ids, persist_cut, table, unused, whole_text

#: Code points of the normalised text that the second refinement hashes.
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("_id"), F.length(text).alias("_chars"), normalised(text).alias("_norm")).select(
        "_id", "_chars", F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)).alias("_prefix"), F.sha2("_norm", 256).alias("_sha")
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_len, _prefix, _sha, keep_id, keep_chars, group_size) of every group with two rows or more."""
    rows = _signatures(docs, id_col, text_col)
    by_length = rows.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len")
    by_prefix = (
        rows.select("_len", "_prefix").join(by_length, "_len", "left_semi")
        .groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len", "_prefix")
    )
    best = F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"))
    return (
        rows.join(by_prefix, ["_len", "_prefix"], "left_semi")
        .groupBy("_len", "_prefix", "_sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("_best")).filter("group_size > 1")
        .select("_len", "_prefix", "_sha", F.col("_best.i").alias("keep_id"), (-F.col("_best.c")).alias("keep_chars"), "group_size")
    )


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_chars."""
    rows = _signatures(docs, id_col, text_col)
    groups = duplicate_groups(docs, id_col, text_col)
    alone = F.col("group_size").isNull()
    return rows.join(groups, ["_len", "_prefix", "_sha"], "left").select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("keep_chars")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.col("_chars").cast("long").alias("n_chars"),
    )


def _shared_prefixes(rows: DataFrame) -> DataFrame:
    """The ids of rows whose length, and prefix hash among those of one length, other rows share."""
    by_length = rows.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len")
    by_prefix = rows.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").join(by_length, "_len", "left_semi").select("_len", "_prefix")
    return rows.join(by_prefix, ["_len", "_prefix"], "left_semi").select(F.col("_id").alias("_candidate")).distinct()


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each group of equal texts, with the columns of ``docs``.

    Lengths and prefix hashes are written once. Only rows that share both
    have their full content hashed: their texts are fetched by id, which no
    group makes hot, and so are the rows that stay.
    """
    keys = persist_cut(_signatures(docs, id_col, text_col).select("_id", "_len", "_prefix"))
    candidates = _shared_prefixes(keys)
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    asked = texts.join(candidates, texts["_id"].eqNullSafe(candidates["_candidate"]), "left_semi")
    hashed = persist_cut(asked.select("_id", F.length("_text").cast("long").alias("_chars"), F.sha2(normalised(F.col("_text")), 256).alias("_sha")))
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i")))
    groups = hashed.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n"), best.alias("_best")).filter("_n > 1").select(F.col("_sha").alias("_of"), "_best")
    stays = F.col("_id").eqNullSafe(F.col("_best.i")) & (F.col("_chars") == -F.col("_best.c"))
    gone = hashed.join(groups, F.col("_sha") == F.col("_of")).filter(~stays).select(F.col("_id").alias("_gone_id"), F.col("_sha").alias("_gone_sha"), F.col("_chars").alias("_gone_chars"))
    row_id, row_sha, row_chars = unused(docs, "_row_id", "_row_sha", "_row_chars")
    if not has_repeated_ids(docs, id_col):
        keyed = docs.withColumn(row_id, F.col(id_col))
        return keyed.join(gone, keyed[row_id].eqNullSafe(gone["_gone_id"]), "left_anti").select(*docs.columns)
    # An id of several rows doesn't tell which of them goes, and a kept row may be repeated.
    keyed = docs.withColumns({row_id: F.col(id_col), row_sha: F.sha2(normalised(whole_text(text_col)), 256), row_chars: F.length(whole_text(text_col)).cast("long")})
    on = keyed[row_id].eqNullSafe(gone["_gone_id"]) & (keyed[row_sha] == gone["_gone_sha"]) & (keyed[row_chars] == gone["_gone_chars"])
    return keyed.join(gone, on, "left_anti").dropDuplicates([row_id, row_sha, row_chars]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY sha) AS n
  FROM t
)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""
