"""The driver's entry with the training-data operators."""

import __spark_entry__


def test_all_thirteen_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names
