"""The registered queries against SQL or brute force, and the pipeline, at the smallest scale."""

import duckdb
import pytest

import corpus_pipeline
from spanloom.llm.oracle import ORACLE
from spanloom.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.test_operators import brute_classes, pairs_of


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_similar_documents(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op3_jaccard_join"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(pairs_of(documents))


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == documents.columns
        kept.append(docs.count())
    assert documents.count() > kept[0] > kept[1] == kept[2] > kept[3] > 150
    assert corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().count() == kept[3]
