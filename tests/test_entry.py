import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["knn_cosine", "range_l2", "medoid", "symmetric_graph", "scc_membership", "dag_parents", "event_windows", "knn_projected", "index_update", "index_dedup", "scc_pruned_children"]


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_works_without_llm(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("vecloom.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named '{name}'", name=name)

    for name in [m for m in sys.modules if m.startswith("vecloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    import vecloom

    monkeypatch.delattr(vecloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    bare = importlib.import_module("__spark_entry__")
    assert "knn_cosine" in bare.queries() and not any(k.startswith("op") or k == "pipeline" for k in bare.queries())
    monkeypatch.undo()
    sys.modules["__spark_entry__"] = entry


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
    for col in cols:
        if a[col].dtype.kind == "f":
            assert ((a[col] - b[col]).abs().fillna(0) < 2e-6).all()
        else:
            assert (a[col].astype(str) == b[col].astype(str)).all()
