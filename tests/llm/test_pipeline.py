"""The pipeline against a brute-force version built from the stages' own definitions, and the SQL of the operators."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from conftest import SF, rows_of
from plantflow.llm import mixing, queries, toxicity
from test_operators import brute_components, normal, table, tiktoken_encoder


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    want = duck.execute(queries.ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_pipeline_matches_brute_force(spark):
    docs, labels = table(spark), table(spark, "labels")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id not in toxic]
    first = {}
    for d, t, s in sorted(rows):
        first.setdefault(normal(t), (d, t, s))
    roots = {d: c for d, _, c in brute_components([(d, t) for d, t, _ in first.values()])}
    left = [(d, t, s) for d, t, s in first.values() if roots[d] == d]
    mixed = mixing.mix(spark.createDataFrame(left, "doc_id long, text string, source string")).collect()
    enc = tiktoken_encoder()
    want = sorted((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest()) for r in mixed)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == want


def test_stages_keep_columns_and_clean_rows(spark):
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    clean = table(spark, "labels").where("toxic = 0").join(docs, "doc_id").select("doc_id")
    kept = toxicity.drop_toxic(docs, table(spark, "labels")).select("doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.02 * clean.count()
