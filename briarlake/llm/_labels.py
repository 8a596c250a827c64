"""A bounded, repeatable sample of labelled texts for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.llm._store import ids_and_text


def fold(modulus: int):
    """crc32(doc_id as text) mod modulus."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, column: str, in_fold, per_class: int) -> tuple[list[tuple[str, int]], float]:
    """Up to per_class texts of either label, chosen by a hash of doc_id, and label 1's share among all labelled rows that may be learned.

    Null labels and doc_ids are left out; repeated labels of a document are settled by majority, ties as 1. Only the chosen
    ids (at most 2 * per_class) are broadcast, and only their texts come to the driver.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y"))
    own = own.where("doc_id is not null and y is not null").where(in_fold).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    share = own.agg(F.avg("y")).first()[0]
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    rows = ids_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").dropDuplicates(["doc_id"])
    found = sorted((r.doc_id, r.text or "", r.y) for r in rows.toLocalIterator())
    return [(t, y) for _, t, y in found], 0.5 if share is None else float(share)
