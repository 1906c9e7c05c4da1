"""Of the sources: nothing is defined twice, imported in vain, or imports the training-data operators."""

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
FILES = sorted(p for p in [*(ROOT / "plumbline").rglob("*.py"), *(ROOT / "tests").glob("*.py"), *ROOT.glob("*.py")])


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_no_name_is_defined_twice_or_imported_in_vain(path):
    tree = ast.parse(path.read_text())
    for scope in [tree, *(n for n in ast.walk(tree) if isinstance(n, ast.ClassDef))]:
        names = [n.name for n in scope.body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), sorted(n for n in names if names.count(n) > 1)
    imported = {(a.asname or a.name).split(".")[0]: n for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names}
    exported = {x.value for n in tree.body if isinstance(n, ast.Assign) and any(getattr(t, "id", "") == "__all__" for t in n.targets) for x in n.value.elts}
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | exported | {"annotations"}
    unused = set(imported) - used
    assert not {u for u in unused if "# noqa: F401" not in path.read_text().splitlines()[imported[u].lineno - 1]}


def test_nothing_but_the_entry_imports_the_training_data_operators():
    for path in (ROOT / "plumbline").rglob("*.py"):
        if path.parent.name != "llm":
            assert "llm" not in path.read_text(), path
