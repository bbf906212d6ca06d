"""The queries of this subpackage and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dramatis.llm import bpe, exact_dedup, langid, packing, repeats, secrets, sharding, simhash, topk, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_warc": warc.op3_warc,
    "op4_bpe": bpe.op4_bpe,
    "op5_langid": langid.op5_langid,
    "op6_repeats": repeats.op6_repeats,
    "op7_simhash": simhash.op7_simhash,
    "op8_secrets": secrets.op8_secrets,
    "op9_topk": topk.op9_topk,
    "op10_packing": packing.op10_packing,
    "pipeline": pipeline,
}
ORACLE = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_warc": warc.ORACLE,
    "op9_topk": topk.ORACLE,
}
