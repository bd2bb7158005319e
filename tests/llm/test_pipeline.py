"""The pipeline's stages on small tables: what goes, what stays, and what comes out."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scenewatch.llm import rules
from tests.llm.test_operators import classes_by_force, odd_rows, shingles


def staged(spark, sf_dir, docs, path):
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        outs.append(docs)
    return outs


def test_stages(spark, sf_dir, tmp_path):
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    language, quality, single, mixture, tokens = staged(spark, sf_dir, first, str(tmp_path))
    assert all(d.columns == first.columns for d in (language, quality, single, mixture))
    assert language.count() >= 0.97 * first.count()
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    long = rules.statistics(language.join(good, "doc_id"), "doc_id").where(~rules.base_failed())
    assert quality.join(long, "doc_id", "left_semi").count() >= 0.95 * long.count()
    want = classes_by_force({r.doc_id: shingles(r.text) for r in quality.collect()}, 0.8)
    kept, gone = {r.doc_id for r in single.collect()}, [i for i, c in want.items() if i != c]
    assert set(want.values()) <= kept and sum(i not in kept for i in gone) >= 0.9 * len(gone)
    taken = Counter(r.doc_id for r in mixture.collect())
    assert max(taken.values()) <= 2 and set(taken) <= {r.doc_id for r in single.collect()}
    assert tokens.count() == mixture.count() and tokens.where(~F.col("exact")).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages_bear_trouble(spark, sf_dir, tmp_path, empty):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for k, name in enumerate(("_doc", "_h", "_copy", "good", "toxic", "shard", "slot", "h", "key", "score", "n_words", "size", "finish", "lang_pred")):
        docs = docs.withColumn(name, F.lit(k))
    outs = staged(spark, sf_dir, docs.where("false") if empty else docs, str(tmp_path))
    assert all(d.columns == docs.columns for d in outs[:-1])
    if empty:
        assert all(d.isEmpty() for d in outs)
    else:
        texts = {r.doc_id: r.text for r in outs[-2].collect()}
        assert texts and {i: len(t.split()) for i, t in texts.items() if len(t.split()) < 50} == {}
        assert outs[-1].count() == outs[-2].count() and outs[-1].where("not exact or n_tokens = 0").isEmpty()
