"""The entry module, and that it works without the optional parts."""

import ast
import importlib
import pathlib
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_optional_modules(monkeypatch):
    real = importlib.import_module

    def gone(name, *a):
        if name in ("skein.llm.queries", "corpus_pipeline"):
            missing = "skein.llm" if name.startswith("skein") else name
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    names = set(entry.queries())
    assert "hybrid_fusion" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_nothing_else_imports_them():
    for path in (ROOT / "skein").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert "skein" in sys.modules
