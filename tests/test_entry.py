import importlib
import sys

import __spark_entry__


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_stands_alone(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("framescope.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "framescope.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert alone.llm is None and "q01_type_histogram" in alone.queries() and "pipeline" not in alone.queries()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
