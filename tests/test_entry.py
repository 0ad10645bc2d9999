"""The driver's contract."""

import builtins
import importlib
import os
import sys

import pytest


def fresh(monkeypatch, missing=False):
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    if missing:
        for name in [m for m in sys.modules if m.startswith("ionforge.llm") or m == "corpus_pipeline"]:
            monkeypatch.delitem(sys.modules, name)
        real = builtins.__import__

        def without(name, *a, **k):
            if name == "corpus_pipeline" or name.startswith("ionforge.llm"):
                raise ImportError(name)
            return real(name, *a, **k)

        monkeypatch.setattr(builtins, "__import__", without)
    return importlib.import_module("__spark_entry__")


def test_names(monkeypatch):
    e = fresh(monkeypatch)
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 50


def test_without_the_training_data_operators(monkeypatch):
    e = fresh(monkeypatch, missing=True)
    assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    assert "search_hybrid" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark, monkeypatch):
    df = fresh(monkeypatch).entry(spark)
    assert df.columns == ["query_id", "db_id", "score", "is_decoy", "q"]
    assert df.count() == 25
