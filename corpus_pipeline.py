"""A training corpus from raw documents: language, exact copies, near copies, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each
stage's rows as Parquet in the shared folder and reads them again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common, exact_dedup, lang_id, packing, passages, simhash

#: Documents whose language is less certain than this, or that have no letters, go.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; the network learns from rows of `docs` that aren't held out."""
    network = lang_id.fit(docs, ~common.held_out(F.col("doc_id")))
    kept_by = {c: common.fresh(f"{c}_before", docs.columns) for c in ("score", "lang_pred") if c in docs.columns}
    known = lang_id.predict(docs.withColumnsRenamed(kept_by), network)
    kept = known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in kept_by.items()})


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the smallest id."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (sets of five-word shingles alike to 0.8 or more) keep the document with the smallest id (one row of it)."""
    found = simhash.similar_documents(docs, shingle=5, similarity=0.8)
    own, sha, copies = (common.fresh(c, docs.columns) for c in ("kept_id", "kept_sha", "copies"))
    # a row is known by its id and text, since an id may stand on several rows
    kept = found.groupBy(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).agg(F.count(F.lit(1)).alias(copies), F.max("kept").alias("kept")).where("kept").drop("kept")
    kept = common.stash(kept, "kept")
    common.discard(found.numbered)
    text = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)
    same = docs["doc_id"].eqNullSafe(kept[own]) & (text == kept[sha])
    out = docs.join(kept.where(F.col(copies) == 1), same, "left_semi")
    if kept.where(F.col(copies) > 1).limit(1).count():  # rows of one id and one text: one stays
        again = docs.join(kept.where(F.col(copies) > 1), same, "left_semi").withColumn(sha, text)
        out = out.unionByName(again.dropDuplicates(["doc_id", sha]).drop(sha))
    return out


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of passages of fifty words or more out; documents of which nothing is left go."""
    was = common.fresh("was_blank", docs.columns)
    blank = F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""
    cut = passages.remove_passages(docs.withColumn(was, blank))
    cut = cut.where(~blank | F.col(was)).drop(was)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096, remembered=100_000)


STAGES = [("language", language), ("exact", exact), ("near", near), ("passages", repeated_passages), ("packing", pack)]

#: No SQL can state the network's predictions, so the stages' operators are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
