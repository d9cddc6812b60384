"""A cleaning pipeline over ``documents``: quality rules, near duplicates, repeated passages, personal
data, packing.  Each stage works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import jaccard, packing, pii, quality, suffix
from flowmill.llm.common import cut, documents
from flowmill.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail them.

    The verdict is written beside the row: a filter on it would be pushed below the projection, and
    each of its columns computed again in the filter.
    """
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    judged = quality.quality_rules(rows, id_col="row").select("row.*", "kept")
    return cut(judged, "judged").filter("kept").drop("kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares 5-word shingles to 0.8 or more: that of the smallest id.

    Null ids come after all others; among rows of one id a hash of the text decides, and of equal rows (id and
    text) one stays.  Rows without a word, so null texts as well, are in no group and stay, even if they repeat.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    found = jaccard.jaccard_components(keyed, 5, (4, 5), key_col="_key").filter("root is not null")
    found = cut(found.select("root", "doc_id", F.col("row_key").alias("_key")), "members")
    best = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_key")).alias("best"))
    judged = found.join(best, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("_key") == F.col("best._key")))
    marks = cut(judged.groupBy("_key").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1"), "marks")
    left = keyed.join(marks, "_key", "left").filter("stays is null or stays")
    if not marks.filter("stays").isEmpty():  # rows that repeat as a whole
        left = left.filter("stays is null").unionByName(left.filter("stays").dropDuplicates(["_key"]))
    return left.select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; those of which no word is left go.

    Cuts move to the borders of characters, so nothing else of a text changes.  Rows of which nothing is cut stay as
    they are, null and empty texts included; rows that repeat an id and text share their cuts.
    """
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "doc_id", "text")
    left = suffix.remove_repeats(rows, payload_col="row", whole_chars=True)
    uncut = F.size("spans") == 0
    text = F.when(uncut, F.col("row.text")).otherwise(F.col("kept").cast("string"))
    out = left.filter(uncut | F.col("kept").cast("string").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return out.select("row.doc_id", text.alias("text"), "row.lang", "row.source").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds; null texts stay null."""
    hidden = pii.masked(docs.select(*COLUMNS))
    return hidden.withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens; a null or empty text is its end id only."""
    return packing.pack(packing.piece_table(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Suffix order, the random field and packing aren't expressed in SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
