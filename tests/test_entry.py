"""The driver's contract: names agree, the flagship runs, queries stand without the training-data subpackage."""

import __spark_entry__ as entry


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 40
    assert 0 < entry.entry(spark).count() <= 20


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "jobloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "jobloom.llm" in p.read_text()]
