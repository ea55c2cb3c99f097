"""Bounded, documented samples of labelled texts, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows joined with labels (doc_id, distinct, and a label), which are broadcast where they are few, so that the texts
    are not shuffled."""
    return rows.join(small(labels), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame | None, label: str, per_label: int, most_chars: int) -> list[tuple[str, str]]:
    """(label, text) of at most per_label distinct whole texts of each label, none longer than most_chars.

    The label is a column of labels (doc_id and the label), or without them of docs.  The texts with the smallest hashes
    are taken, so the sample depends neither on the partitions nor on how often a text is copied.  Only hashes are joined
    and ranked; the texts of the chosen rows are then read.  Null labels and texts are left out.
    """
    fits = docs.where("text is not null").where((F.length("text") <= most_chars) & (F.length("text") > 0))
    own = [] if labels is not None else [F.col(label).cast("string").alias("label")]
    hashed = fits.select("doc_id", F.xxhash64("text").alias("h"), *own)
    if labels is not None:
        hashed = hashed.join(labels.select("doc_id", F.col(label).cast("string").alias("label")), "doc_id")
    hashed = stored(hashed.where("label is not null").select("label", "h").distinct(), "sample-hashes")
    # Ranked are only hashes so small that about 4 * per_label of a label are as small: no task ranks a label whole.
    sizes = hashed.groupBy("label").agg(F.count("*").alias("n"))
    upto = -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), F.lit(4.0 * per_label) / F.col("n"))
    low = hashed.join(small(sizes), "label").where(F.col("h") <= upto)
    first = low.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("r") <= per_label)
    chosen = sorted((r.label, r.h) for r in first.select("label", "h").collect())
    if not chosen:
        return []
    wanted = sorted({h for _, h in chosen})
    found = fits.select(F.xxhash64("text").alias("h"), "text").where(F.col("h").isin(wanted)).dropDuplicates(["h"])
    texts = {r.h: r.text for r in found.collect()}
    return [(c, texts[h]) for c, h in chosen]
