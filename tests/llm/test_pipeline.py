"""The pipeline, stage by stage, against brute force on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from dramatis.llm import bpe, langid, secrets
from tests.llm.test_similar import brute_groups

SF = "/root/testdata/sf0.001"


def lower_ascii(text):
    return text.encode().lower()


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("dropped_id", F.lit(1))
    planted = [(10_000 + k, t) for k, t in enumerate([None, "", "12 !! 34", "The password = hunter2222 is here and there with the others"])]
    extra = spark.createDataFrame(planted, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("dropped_id"))
    docs = docs.unionByName(extra)
    before = {r.doc_id: r for r in docs.collect()}
    net, models, names = langid.trained(docs), None, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in out.collect()} if name != "packing" else {}
        if name != "packing":
            assert out.columns == names
        if name == "language":
            answer = langid.answers(net, [r.text for r in before.values()])
            assert set(after) == {i for i, lang, score in zip(before, *answer, strict=True) if lang != "und" and score >= langid.LEAST_SCORE}
            assert not {10_000, 10_001, 10_002} & set(after) and len(after) > 0.97 * len(before) - 3
        elif name == "exact":
            best = {}
            for i, r in before.items():
                best[lower_ascii(r.text)] = max(i, best.get(lower_ascii(r.text), i))
            assert set(after) == set(best.values())
        elif name == "near":
            roots = brute_groups([(i, before[i].text) for i in sorted(before)])
            gone = {i for i, root in roots.items() if i != root}
            assert set(before) - gone <= set(after) <= set(before) and len(set(after) & gone) <= 0.1 * len(gone)
        elif name == "secrets":
            models = secrets.trained(docs)
            assert set(after) == set(before)
            for i, r in after.items():
                assert r.text == secrets.redact(before[i].text, secrets.find_spans(before[i].text, models)) and r.n_chars == len(r.text)
            assert after[10_003].text == "The [secret] is here and there with the others"
        else:
            own, rows = bpe.tokenizer(bpe.vocabulary()), out.collect()
            lengths = {}
            for r in rows:
                lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
            assert lengths == {i: len(own.encode(r.text)) + 1 for i, r in before.items()}
        docs, before = out, after


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)
