"""Components that do not come to an end."""

import pytest

from prunella.llm import components


def test_rounds_that_do_not_suffice_are_an_error(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    with pytest.raises(ArithmeticError):
        components.connected_components(edges)
