"""The Bloom filters miss nothing and hold little by mistake, whatever part of the range is sent."""

import numpy as np
import pytest

from tablewise.llm import bloom
from tablewise.session import stage


@pytest.mark.parametrize("top", [2**64 - 1, 2**62])
def test_filters(spark, top):
    rng = np.random.default_rng(1)
    once, twice, other = (rng.integers(0, top, 20_000, np.uint64, endpoint=True) for _ in range(3))
    sent = np.concatenate([once, twice, twice]).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in sent] + [(None,)], "h long").repartition(7)
    rows = stage(bloom.packed_column(df, "h"), "bloom-test")
    first, second = bloom.build(rows, twice=False), bloom.build(rows, twice=True)
    assert first.holds(once).all() and first.holds(twice).all() and second.holds(twice).all()
    assert first.holds(other).mean() < 0.05 and second.holds(once).mean() < 0.05


def test_filter_of_nothing(spark):
    rows = stage(bloom.packed_column(spark.createDataFrame([], "h long"), "h"), "bloom-test")
    assert not bloom.build(rows, twice=True).holds(np.arange(100, dtype=np.uint64)).any()
