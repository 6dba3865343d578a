"""Bounded, deterministic samples of labelled and unlabelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def first_by_hash(frame: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, those of smallest hash of the id.

    A threshold on the hash, set from the number of rows, leaves hardly more
    than ``rows`` over all tasks, so that what is sorted stays bounded.
    """
    total = frame.count()
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    share = (rows + 6 * rows**0.5 + 10) / max(total, 1)
    if share < 1:
        frame = frame.filter(place < int(share * (1 << 30)))
    return frame.orderBy(place, id_col).limit(rows)


def labelled(docs: DataFrame, labels: DataFrame, label: str, value: int, rows: int, train: Column, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` documents with this label among the training rows; the ids, at most ``rows``, are broadcast."""
    ids = first_by_hash(labels.filter(train & (F.col(label) == value)).select(id_col).distinct(), rows)
    return docs.join(F.broadcast(ids), id_col, "left_semi")
