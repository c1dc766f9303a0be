"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from curatrix.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Five folds need more groups a stratum than the smallest tables have, quotas and gates likewise.
SMALL = {"oof_plan", "oof_materialized", "fold_complements", "oof_collected", "quota_controls", "expected_counts", "group_kfold", "balanced_epoch", "source_balanced_epoch"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def normal(value):
    return None if value is None or value != value else f"{value:.9f}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - SMALL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF_DIR)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = sorted(repr([normal(r[c]) for c in columns]) for r in got.collect())
    theirs = sorted(repr([normal(r[want.columns.index(c)]) for c in columns]) for r in want.fetchall())
    assert mine == theirs


def test_entry_works_without_the_optional_subpackage(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("curatrix.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "curatrix.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalogue.QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
