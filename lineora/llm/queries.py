"""The queries of the training-data operators: each applies its operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineora.llm import decontaminate, extract, jaccard, langid, mixture, quality_lm, repetition, secrets, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in two pushes, by source; the second scans only what the first has not brought."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ledger = secrets.Ledger(spark)
    first = F.xxhash64(F.coalesce("source", F.lit(""))) < 0
    for push in (docs.where(first), docs.where(~first)):
        ledger.extend(push)
    found = secrets.findings(docs.drop("source"), ledger.table()).drop("text")
    of_kinds = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = of_kinds(*(r.kind for r in secrets.BASE))
    counts = [F.size(of_kinds(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(_table(spark, sf_dir, "documents"), shards=24, tolerance=0)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents")).drop("shares")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    learned = langid.prototypes(docs.where(~held_out))
    return langid.predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), learned).drop("text")


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.mixed_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {
    "op1_blob_ledger": op1_blob_ledger,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_histogram_sort": op3_histogram_sort,
    "op4_repetition": op4_repetition,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_mixture": op9_mixture,
    "op10_main_text": op10_main_text,
}
