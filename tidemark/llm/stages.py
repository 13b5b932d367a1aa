"""The operators as stages of a pipeline over documents: each takes documents and returns those it keeps, or the result.

Nulls and odd rows are as the operators define them: a null or empty text is scored like any other and may be kept; null
and repeated ids are rows like any other, but one of rows that agree in id and text stays of near-duplicates; an empty table
gives an empty result. Extra columns are returned unchanged; other columns than text and n_chars are never changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing, packing, quality, simhash, toxicity
from .common import cut, unpacked

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least chance to be toxic that rejects a document, and least chance of good quality that keeps it.
TOXIC, GOOD = 0.5, 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the text: rows that agree in these have equal results in every operator."""
    return docs.select("doc_id", F.xxhash64("text").alias("stage_key"), "text")


def _kept(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text hash are in keys."""
    own = keys.select(F.col("doc_id").alias("kept_id"), F.col("stage_key").alias("kept_key")).distinct()
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_key")), "left_semi")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the voters don't find toxic."""
    scored = toxicity.classify(_keyed(docs), labels)
    return _kept(docs, scored.where(F.col("score") < TOXIC))


def good_ones(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of good quality."""
    scored = quality.classify(_keyed(docs), labels)
    return _kept(docs, scored.where(F.col("score") >= GOOD))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, and one row of it."""
    groups = simhash.near_duplicates(_keyed(docs))
    root = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp "), F.col("fp").cast("string")))
    # of ids in a group the smallest that is not null
    first = groups.groupBy(root.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "stage_key")).alias("k"))
    own = docs.join(first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.stage_key").alias("kept_key")), F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_key")), "left_semi")
    same = docs.select("doc_id", F.xxhash64("text").alias("stage_key")).groupBy("doc_id", "stage_key").agg(F.count("*").alias("n")).where("n > 1")
    repeated = cut(same.select(F.col("doc_id").alias("kept_id"), F.col("stage_key").alias("kept_key")))
    if repeated.isEmpty():
        return own
    match = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_key"))
    once = own.join(repeated, match, "left_anti")
    many = own.join(repeated, match, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("kept_key")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("kept"))
    return once.unionByName(many.select(*unpacked(docs.columns)))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix of sources: whole and partial repetitions of the documents' texts, n_chars being of these."""
    texts = mixing.texts(mixing.mix(docs))
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    parts = packing.pieces(docs.select("doc_id", "text"), tokenizer, words=packing.STAGE_WORDS)
    return packing.packed(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
