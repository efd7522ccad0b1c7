"""From documents to packed token sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes what it returns to the shared folder and reads it again for the next,
so a lost executor costs one stage at most. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import language, mixing, nearcopies, packing, repeats
from gridweave.llm.common import named, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, or no letter in it. A missing label is filled in."""
    judged = language.identify(docs, carry=True).where(F.col("lang_pred") != language.UNKNOWN)
    label = F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang")
    return judged.select(*[label if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Documents without an id or a word are in no group and stay. Rows of one id with unlike texts are documents of their own; of rows
    with one id and one text the smallest stays.
    """
    judged = nearcopies.near_copies(docs).where("kept")
    kept = stored(judged.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")), "kept")
    marked = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), F.sha2("text", 256).alias("digest"), F.col("text").rlike(r"\S").alias("worded"))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"), "rows")
    same = F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & F.col("digest").eqNullSafe(F.col("kept_digest"))
    marked = marked.join(kept, same)
    repeated = (F.col("rows") > 1) & F.col("worded") & F.col("row.doc_id").isNotNull()
    single = marked.where(~F.coalesce(repeated, F.lit(False))).select("row.*")
    smallest = marked.where(repeated).groupBy("row.doc_id", "digest").agg(F.min("row").alias("row"))
    return single.union(smallest.select("row.*"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has go, at whole characters; the document stays."""
    left = repeats.remove_repeats(docs, form="text", carry=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return left.select(*[(new[c] if c in new else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    sized = docs.withColumn("_size", mixing.word_count(F.col("text")))
    return mixing.take(mixing.mix_sources(sized, size="_size")).select(*map(named, docs.columns))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Fitted models, sketches and tokenisers are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
