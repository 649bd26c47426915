"""Every query with SQL against it, over the smallest tables; the others run and give their columns."""

import pytest

import __spark_entry__ as entry
from compare import differences

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    n, diff = differences(spark, DIR, name)
    assert not diff, diff


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_needs_the_text_package():
    import ast
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for p in [*root.glob("codelattice/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" in p.relative_to(root).parts:
            continue
        for x in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or ""] if isinstance(x, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p
