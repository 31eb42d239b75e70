import ast
import importlib
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).parents[1]


def test_names_agree():
    importlib.reload(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["athlete_id", "date", "ctl", "atl", "tsb"]


def test_nothing_else_imports_the_subpackage():
    for p in REPO.glob("ridgeline/**/*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                if isinstance(node, ast.ImportFrom | ast.Import):
                    assert "llm" not in ast.unparse(node), p
