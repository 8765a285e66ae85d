"""What the entry point does without the optional operators, and with broken ones."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry


def test_absent_and_broken_modules(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "needs_a_package.py").write_text("import no_such_package\n")
    (tmp_path / "needs_own_part.py").write_text("import heddle.no_such_part\n")
    (tmp_path / "names_nothing.py").write_text("from json import no_such_name\n")
    assert entry.optional("needs_a_package") is None
    with pytest.raises(ModuleNotFoundError):
        entry.optional("needs_own_part")
    with pytest.raises(ImportError):
        entry.optional("names_nothing")


def test_queries_without_the_optional_ones(monkeypatch):
    monkeypatch.setattr(entry, "llm", None)
    monkeypatch.setattr(entry, "pipeline", None)
    assert "filter_stats" in entry.queries() and not [n for n in entry.queries() if n.startswith("op1_") or n == "pipeline"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
