import hashlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(5)
    prose = lambda: " ".join(f"word{w}" for w in rng.integers(0, 5000, 80))
    rows = [(i, prose(), "en", "a" if i % 3 else "b", 0) for i in range(200)]
    rows = [(i, t + (" vile slur" if i % 8 == 0 else ""), *r) for i, t, *r in rows]
    rows += [(300 + i, rows[1][1], "en", "a", 0) for i in range(5)] + [(400, None, "en", None, 0), (401, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = ["copies", "position", "score", "_h", "_id", "_hash", "_toxicity_score", "a.b", "c5", "row", "_key", "node", "toxicity"]
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in odd])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "mixing", "encoding"]
    got, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame((out := stage(spark, now, str(tmp_path))).collect(), out.schema)
        got[name] = now
        if name != "encoding":
            assert now.columns == docs.columns
            assert all(r[c] == f"{c}-{r.doc_id}" for r in out.collect() for c in odd)
    clean = {r.doc_id for r in got["toxicity"].collect()}
    assert clean == {r[0] for r in rows if not (r[0] < 200 and r[0] % 8 == 0)}
    single = {r.doc_id for r in got["near duplicates"].collect()}
    assert single == clean - {300 + i for i in range(5)}
    copies = Counter(r.doc_id for r in got["mixing"].collect())
    assert set(copies) <= single and 0 < len(copies)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in final) == copies
    sha = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in rows}
    assert all(r.decoded_sha256 == sha[r.doc_id] for r in final)


def test_pipeline_of_blank_repeats_and_of_nothing(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["\n", "\n", None, None, "", "one text of some words that is here twice", "one text of some words that is here twice"]
    rows = [(1, t, None, None, None) for t in texts]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for k, some in enumerate((rows, [])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(some, shape).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        kept = corpus_pipeline.without_near_duplicates(spark, corpus_pipeline.without_toxic(spark, docs, folder), folder)
        assert Counter(r.text for r in kept.collect()) == (Counter(["\n", "\n", None, None, "", texts[5]]) if some else Counter())
        final = corpus_pipeline.run(spark, folder)
        assert "ids_sha256" in final.columns and (some or final.count() == 0)
