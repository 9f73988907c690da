"""Every operator on empty tables, null columns, repeated rows, clashing column names and very long texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lineora.llm import decontaminate, extract, jaccard, langid, mixture, quality_lm, repetition, secrets, sharding, warc

CLASH = ("spans", "times", "size", "shard", "slot", "kept", "score", "lang_pred", "n_trigrams", "sig", "key", "n", "kind", "text_hash", "blob_id", "m", "doc", "tokens", "perplexity", "__id", "__blob", "__hash", "__row", "__0", "root", "items", "n_hit", "digest", "host", "lines")
BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def ledgered(docs):
    ledger = secrets.Ledger(docs.sparkSession)
    ledger.extend(docs)
    return secrets.findings(docs, ledger.table())


def operators(spark):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, None), (2, "")], BENCH)
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 0, 1)], LABELS)
    pages = lambda d: d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    return {
        "op1": ledgered,
        "op2": lambda d: quality_lm.classified(d, labels),
        "op3": lambda d: sharding.sharded(d, shards=3, keep=True),
        "op4": repetition.repetition,
        "op5": lambda d: decontaminate.benchmark_hits(d, bench),
        "op6": jaccard.similarity_classes,
        "op7": lambda d: warc.round_trip(pages(d)),
        "op8": lambda d: langid.predicted(d, langid.prototypes(d)),
        "op9": mixture.mixed_documents,
        "op10": lambda d: extract.main_text(pages(d)),
    }


def rows_like(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(1000)}" for _ in range(120_000))
    rows = [(1, "a plain text of a few words", "en", "s"), (1, "a plain text of a few words", "en", "s"), (None, None, None, None), (None, None, None, None), (2, "", "en", None), (3, long, "fr", "t"), (None, "text without an id", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH}), len(rows)


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_edges(spark, name):
    apply = operators(spark)[name]
    df, n = rows_like(spark)
    assert len(apply(df).collect()) == n
    empty = apply(df.limit(0))
    assert empty.count() == 0 and empty.columns == apply(df).columns


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", "x y z w v"), ("a", "x y z w v"), (None, "other")], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similarity_classes(df).collect()} == {"a": "a", "b": "a", None: None}
    assert sorted(r["slot"] for r in sharding.sharded(df, shards=1).collect()) == [0, 1, 2]
    assert sorted(r["doc_id"] or "" for r in jaccard.one_of_each(df).collect()) == ["", "a"]


def test_ledger_scans_only_unseen_pairs(spark):
    a = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "b")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "token=abcdefgh1"), (4, "secret=abcdefgh2")], "doc_id long, text string")
    ledger = secrets.Ledger(spark)
    assert ledger.table().count() == 0 and ledger.extend(a).count() == 2
    assert ledger.extend(b).count() == 1 and ledger.extend(a.union(b)).count() == 0
    newer = (*secrets.RULES[1:], secrets.Rule("assign", secrets.RULES[0].pattern, 2, 4, version=2))
    assert {tuple(r["rules"]) for r in ledger.extend(a, newer).collect()} == {("assign@2",)}
    both = a.union(b)
    key = lambda df: sorted((r["doc_id"], str(r["spans"])) for r in df.collect())
    assert key(secrets.findings(both, ledger.table())) == key(secrets.findings(both, secrets.scan(both)))


def test_pipeline_edges(spark, tmp_path):
    df, _ = rows_like(spark)
    spark.createDataFrame([(1, "w1 w2 w3")], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (df, df.limit(0)):
        columns = docs.columns
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if i + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == columns, name
            docs.write.mode("overwrite").parquet(path := str(tmp_path / name))
            docs = spark.read.schema(docs.schema).parquet(path)
        assert {"shard", "slot"} <= {*docs.columns}
