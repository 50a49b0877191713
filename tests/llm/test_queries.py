import pytest

import corpus_pipeline
from lodestrata.llm import registry
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, folder):
    same(registry.QUERIES[name](spark, folder), connect(folder), registry.ORACLE_SQL[name])


def test_pipeline(spark, folder):
    """Each stage but the last returns documents' columns; what a stage decides is so in its result."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline_table(spark, stage(spark, docs, folder))
        assert docs.columns == columns
        seen[name] = docs.collect()
    ids = [r.doc_id for r in seen["minhash near-dedup"]]
    assert len(ids) == len(set(ids)) <= len(seen["line dedup"]) == len(seen["quality classifier"])
    assert all(r.n_chars == len(r.text) for r in seen["line dedup"])
    mixed = [r.doc_id for r in seen["mixing sources to target weights"]]
    assert set(mixed) <= set(ids) and max(map(mixed.count, set(mixed))) <= 3
    pieces = corpus_pipeline.packing(spark, docs, folder).collect()
    assert sum(r.length for r in pieces if r.start == 0) and {r.doc_id for r in pieces} == set(mixed)


def corpus_pipeline_table(spark, df):
    from lodestrata.scratch import stored

    return stored(df, "test")


def test_registry_has_each_operator_once():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
