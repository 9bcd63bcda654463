"""A bounded sample of labelled documents, for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_bytes, whole_text


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn_from: Column, bound: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of the rows of at most ``bound`` labelled ids, chosen by a hash of the id.

    ``learn_from`` is a condition on ``doc_id``.  Labels other than 0 and 1 and labels without an id
    are left out; of several labels of one id the larger counts.  The bound makes the sample's ids and
    labels small enough to broadcast whatever the tables' size.  An id may have any number of rows."""
    marks = pick(labels, doc_id="doc_id", label=label_col).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.max("label").cast("double").alias("label")).where(learn_from)
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, learn_from: Column, rows: int, size: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``labelled_sample`` with different texts only, at most ``rows`` of them and at most ``size`` bytes of text
    in all: whole texts in the order of a hash, as long as the next one fits.

    An id whose rows all have one text counts once, however many rows it has.  The choice moves two numbers a row
    to the driver, of at most ``rows`` rows."""
    found = labelled_sample(docs, labels, label_col, learn_from, rows, id_col, text_col)
    found = found.select("doc_id", "label", F.xxhash64(whole_text(F.col("text"))).alias("text_key"), "text")
    sizes = found.select("doc_id", "text_key", F.octet_length(text_bytes(F.col("text"))).alias("bytes")).distinct()
    chosen, room = [], size
    for r in sizes.orderBy(F.xxhash64("doc_id", "text_key"), "doc_id", "text_key").limit(rows).collect():
        if r["bytes"] <= room:
            chosen.append((r["doc_id"], r["text_key"]))
            room -= r["bytes"]
    keys = docs.sparkSession.createDataFrame(chosen, found.select("doc_id", "text_key").schema)
    return found.join(F.broadcast(keys), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).drop("text_key")
