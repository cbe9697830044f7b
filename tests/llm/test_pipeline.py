"""The pipeline against the operators' brute-force meaning, stage by stage."""

import random

import corpus_pipeline
from test_operators import ITEMS, long_text, plain_components, plain_hits


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, long_text(80, 900 + i), "en", "src0", 1) for i in range(12)]
    rows += [(20, rows[0][1], "en", "src1", 2), (21, rows[1][1].replace("w1", "w1", 1) + " more", "en", "src1", 2), (22, long_text(60, 44) + " " + ITEMS[0][1], "en", "s", 3), (23, "few words", "en", "s", 3), (24, None, None, None, None), (25, long_text(40, 45) + ' password="hunter2hunter2" ' + long_text(9, 46), "en", "s", 3), (26, "# $ % & " * 40, "en", "s", 3), rows[2], (27, "", "en", "s", 0)]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x for x in ITEMS if x[1] and len(x[1].split()) > 9], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    good = [(i, t) for i, t, *_ in rows if i not in (23, 24, 26, 27)]
    assert seen["quality_rules"] == sorted(good)
    assert sorted({i for i, _ in seen["ngram_jaccard_join"]}) == sorted({c for _, _, c in plain_components(good)}) and len(seen["ngram_jaccard_join"]) == len({i for i, _ in seen["ngram_jaccard_join"]})
    assert seen["benchmark_decontamination"] == [x for x in seen["ngram_jaccard_join"] if not plain_hits(x[1], ITEMS)[1]]
    assert 22 not in {i for i, _ in seen["benchmark_decontamination"]}
    clean = dict(seen["secret_scans"])
    assert "hunter2" not in clean[25] and all(clean[i] == t for i, t in seen["benchmark_decontamination"] if i != 25)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(clean)


def test_clashing_columns(spark, tmp_path):
    """Other columns keep their values, whatever their names."""
    extra = ["key", "same", "kept", "n_words", "items", "label", "digest", "shard", "path"]
    rows = [(i, long_text(60, 700 + i % 3), *[f"{c}{i}" for c in extra]) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *extra])
    spark.createDataFrame([(1, ITEMS[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", *extra], name
    assert sorted(map(tuple, docs.collect())) == rows[:3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 3


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
