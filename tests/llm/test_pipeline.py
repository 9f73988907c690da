import random

import corpus_pipeline
from lineora.llm import mixture


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    item = make(20)
    texts = [make(60) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(50, texts[0], "en", "s0", 1), (51, texts[1] + " tail", "en", "s1", 1), (52, f"{make(20)} {item} {make(20)}", "en", "s2", 1), (53, "123", "en", "s0", 1), (54, None, None, None, None)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "in/documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "in/benchmark.parquet"))
    sf_dir = str(tmp_path / "in")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < 4:
            assert docs.columns == columns
        docs.write.parquet(path := str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(path)
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert ids[0] == {*range(40), 50, 51, 52}
    assert ids[1] == {*range(40), 52}
    assert ids[2] == {*range(40)}
    taken = mixture.mixed_documents(spark.read.parquet(str(tmp_path / "out2")))
    assert ids[3] == {r["doc_id"] for r in taken.where("times > 0").collect()} and docs.count() == spark.read.parquet(str(tmp_path / "out3")).count()
    assert {r["shard"] for r in docs.select("shard").distinct().collect()} <= {*range(24)}
    assert len(corpus_pipeline.STAGES) == 5
