"""The queries opN_<name>: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import codes, decontam, fm_dedup, langid, licenses, merkle, minhash_dedup, ogg, pieces, quality, suffix_dedup, toxicity, urlfilter
from larkspur.llm.tables import table, written

#: Rows whose labels are held out.
HELD_OUT = "crc32(cast(doc_id AS string)) % 3 = 1"
TOXIC_HELD_OUT = "crc32(cast(doc_id AS string)) % 5 = 0"


#: The rules of the URL filter.
RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")


def op1_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL by the rules, else by the classifier over its host's words and path's tokens."""
    pages = table(spark, sf_dir, "pages")
    words = urlfilter.lexicon(pages.select(urlfilter.visible_text(F.col("html")).alias("text")), "text")
    model = urlfilter.fit(pages, words)
    found = urlfilter.judge(pages.select("page_id", "url"), model, urlfilter.rules(*RULES))
    return found.select("page_id", "host", "path", "rule", "verdict", "score", "host_words")


def op2_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every text."""
    return licenses.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an Ogg stream and back: digests of what was read, and features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = ogg.encode_column(docs)
    read = ogg.decode_column(stored, ["doc_id", "n_bytes"])
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(f"NOT ({HELD_OUT})"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that also start earlier."""
    return fm_dedup.dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a similarity of 0.8 or more."""
    found = minhash_dedup.link(table(spark, sf_dir, "documents"), size=4)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op7_streaming_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = pieces.decode_column(pieces.encode_column(docs))
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), same.alias("round_trip"), "ids")


def op8_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text, learned from labels not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = written(quality.features(docs, ["doc_id"]), "stats")
    model = quality.fit(stats.join(labels.where(f"NOT ({HELD_OUT})").select("doc_id", "quality"), "doc_id"))
    return quality.score(stats, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.judge(docs.select("doc_id", "text"), items).drop("text")


def op10_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that also start in a document with a smaller id."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every text, learned from confirmed examples and unlabelled texts that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learned = f"NOT coalesce({TOXIC_HELD_OUT}, false)"
    model = toxicity.fit(docs.where(learned), labels.where(learned))
    found = toxicity.score(docs, model, ["doc_id"])
    return found.select("doc_id", F.expr(TOXIC_HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_screened_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector by codebooks learned from all of them."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_mountain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the proof finds what was tampered with."""
    return merkle.verify(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_host_words": op1_host_words,
        "op2_license_bands": op2_license_bands,
        "op3_ogg": op3_ogg,
        "op4_string_kernel_langid": op4_string_kernel_langid,
        "op5_fm_index": op5_fm_index,
        "op6_coordinate_join": op6_coordinate_join,
        "op7_streaming_pieces": op7_streaming_pieces,
        "op8_quadratic_discriminant": op8_quadratic_discriminant,
        "op9_winnowing": op9_winnowing,
        "op10_prefix_doubling": op10_prefix_doubling,
        "op11_positive_unlabelled": op11_positive_unlabelled,
        "op12_screened_codes": op12_screened_codes,
        "op13_mountain_range": op13_mountain_range,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_bands": licenses.sql(), "op5_fm_index": fm_dedup.SQL, "op6_coordinate_join": minhash_dedup.SQL, "op9_winnowing": decontam.SQL, "op10_prefix_doubling": suffix_dedup.SQL, "op12_screened_codes": codes.sql(), "op13_mountain_range": merkle.SQL}
