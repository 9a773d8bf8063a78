"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again.

Every stage takes the documents that the one before has kept, and all but the
last return the columns of ``documents``; extra columns of the input pass
through, whatever their names.  Null, empty and letterless texts go in the first
stage; rows of the same id are documents of their own; of an empty table every
stage makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, langid, minhash_dedup, pieces, suffix_dedup
from larkspur.llm.tables import drop, nested, table, unnested, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the languages that the corpus names, go."""
    model = langid.fit(docs)
    found = langid.predict(nested(docs), model, out=("lang_pred", "score", "lang_known"))
    return unnested(found.where("lang_known"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates stays (five words, similarity 0.8)."""
    stays = minhash_dedup.keep_first(docs)
    return stays.select(*docs.columns)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has too are cut out; documents of which nothing but white space is left go."""
    cut = suffix_dedup.cut_column(docs)
    left = cut.where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    found = decontam.judge(nested(docs), table(spark, sf_dir, "benchmark"))
    return unnested(found.where(~F.col("contaminated")), docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digest of what they decode to."""
    found = pieces.decode_column(pieces.encode_column(docs.select("doc_id", "lang", "source", "text")))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_bytes),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]

#: The stages use learned models and byte-level search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
            if last is not None:
                drop(last)
            last = docs
    return docs
