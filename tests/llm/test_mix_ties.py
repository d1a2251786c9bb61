"""Targets of sources whose caps stand in the ratio of their weights."""

import brute
import pytest

from qualspark.llm import mixing


@pytest.mark.parametrize("sizes", [{"a": 57, "b": 171, "aa": 0}, {"a": 10, "b": 20, "c": 30}, {"a": 5, "b": 10, "c": 15, "d": 900, None: 10}, {"a": 0, "b": 0}])
def test_targets_of_equal_ratios(spark, sizes):
    given = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(given).collect()}
    assert got == pytest.approx(brute.targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))
