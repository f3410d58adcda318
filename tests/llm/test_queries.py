"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from sweeplog.llm import language_id, minhash_dedup, quality_rules
from sweeplog.llm.frames import fold
from sweeplog.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in REGISTRY) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in ("op3_packing", "op11_collocations", "op12_whitening")])
def test_one_row_for_each_row_of_the_table(spark, name):
    table = "embeddings" if name.startswith("op2_") else "documents"
    key = "vec_id" if table == "embeddings" else "doc_id"
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in REGISTRY[name][0](spark, SF).select(key).collect()) == ids


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    docs = docs.where(docs.doc_id.isin(list(good)))
    model = language_id.fit(docs, fold(docs["doc_id"], 4) != 2)
    told = {r.doc_id for r in language_id.predict(docs, model).where("accepted").collect()}
    docs = docs.where(docs.doc_id.isin(list(told)))
    first = {r.doc_id for r in minhash_dedup.near_duplicates(docs, size=5).where("kept").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == first
    assert all(sum(r.length for r in got if r.doc_id == i) == next(r.doc_tokens for r in got if r.doc_id == i) for i in first)


def test_pipeline_with_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 400 AND 3000").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(good)]
    rows += [(3, good[3], "en", "web", 1), (4, good[30] + " more words", None, None, None), (None, good[20], "en", "web", 1), (50, None, "en", "web", 0), (51, "", None, "web", 0)]
    clash = [(*r, "KEEP", "KEEP", "KEEP", 5, True) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __TEXT string, __lang_key string, __mark string, cid int, kept boolean"
    spark.createDataFrame(clash, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {(r["__TEXT"], r["__lang_key"], r["__mark"], r.cid) for r in docs.collect()} <= {("KEEP", "KEEP", "KEEP", 5)}
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(3) == 1 and len(ids) > 20 and not {50, 51} & set(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids)
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
