"""Registered queries against their SQL, and the pipeline against a plain version."""

import hashlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import TABLES, printed
from fieldspark.llm.queries import QUERIES, SQL, VOCABULARY

from ..conftest import SMALL
from .test_operators import brute_components, brute_hits


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert printed(got.convert_dtypes()) == printed(want.convert_dtypes())


@pytest.mark.parametrize("name, table", [("op1_url_filters", "pages"), ("op5_bpe", "documents"), ("op7_fingerprints", "documents"), ("op8_token_counts", "documents"), ("op9_toxicity", "documents"), ("op10_sharding", "documents")])
def test_one_row_for_each_row(spark, name, table):
    assert QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_pipeline_equals_stages_by_hand(spark, db):
    docs = db.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    items = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    toxic = {r.doc_id for r in QUERIES["op9_toxicity"](spark, SMALL).collect() if r.predicted}
    docs = [d for d in docs if d[0] not in toxic]
    docs_by_id = dict(docs)
    kept = [i for i, _, c in brute_components(docs) if i == c]
    kept = [i for i in kept if not brute_hits(docs_by_id[i], items)[1]]
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    want = set()
    for i in kept:
        ids = library.encode(docs_by_id[i] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
