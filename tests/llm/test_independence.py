"""Nothing outside the subpackage imports it, and no operator swallows import errors."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom):
            yield node.module or ""
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_the_library_stands_alone():
    for path in (ROOT / "headmint").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "headmint").parts:
            assert not any(m.startswith("headmint.llm") for m in imports(path)), path


def test_import_errors_are_not_swallowed():
    for path in [*(ROOT / "headmint" / "llm").glob("*.py"), ROOT / "corpus_pipeline.py"]:
        assert "ImportError" not in path.read_text() and "localCheckpoint" not in path.read_text(), path
