import builtins
import importlib
import sys

import pytest


def reload_without(monkeypatch, name, raised):
    real = builtins.__import__

    def fake(wanted, *args, **kwargs):
        if wanted == name:
            raise raised
        return real(wanted, *args, **kwargs)

    for module in [m for m in sys.modules if m.startswith("benchsieve.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setattr(builtins, "__import__", fake)
    return importlib.import_module("__spark_entry__")


def test_other_queries_survive_a_missing_library_of_training_data(monkeypatch):
    pytest.importorskip("benchsieve.llm")
    entry = reload_without(monkeypatch, "xxhash", ModuleNotFoundError("none", name="xxhash"))
    assert "recommend_5" in entry.queries() and "pipeline" not in entry.queries()


def test_errors_of_the_library_itself_are_not_hidden(monkeypatch):
    pytest.importorskip("benchsieve.llm")
    entry = reload_without(monkeypatch, "xxhash", ImportError("broken", name="benchsieve.functions.durable"))
    with pytest.raises(ImportError):
        entry.queries()
