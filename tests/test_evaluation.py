"""Exact percentiles without a sort in one task; cuts of long messages."""

import random

import numpy as np
import pytest

from quillspark.operators import evaluation as E
from quillspark.operators import messages as M


@pytest.mark.parametrize("values", [
    [3.5], [1.0, 2.0], [0.0] * 50 + [1e-300, -1e-300], [random.Random(1).gauss(0, 1) for _ in range(5000)], [random.Random(2).choice([1.0, 2.0, 2.5]) for _ in range(999)],
    [-1.7e308, 1.7e308, 0.0, 5.0, 5.0, 5.0], [10.0**k for k in range(-200, 200)],
])
def test_percentiles_are_exact(spark, values):
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = E.percentiles(frame, "v", shares)
    ordered = sorted(values)
    for q, v in zip(shares, got, strict=True):
        spot = (len(values) - 1) * q
        low, high = ordered[int(np.floor(spot))], ordered[int(np.ceil(spot))]
        assert v == low + (high - low) * (spot - int(spot))


def test_percentiles_of_nothing(spark):
    assert E.percentiles(spark.createDataFrame([(None,)], "v double"), "v", (0.5,)) == [None]
    row = E.latencies(spark.createDataFrame([], "v double"), "v").first()
    assert row.n == 0 and row.p50 is None


def safe_cut(head, limit):
    """Where a text of at least ``limit`` characters is cut, in plain steps."""
    import re

    ends = [m.end() for m in re.finditer(r"```\s*\n", head)]
    if ends and ends[-1] > limit * 0.5:
        return ends[-1]
    for mark, share in (("\n\n", 0.5), ("\n", 0.5), (". ", 0.5), ("! ", 0.5), ("? ", 0.5), (" ", 0.3)):
        if head.rfind(mark) > limit * share:
            return head.rfind(mark) + len(mark)
    return limit


def test_cuts_are_judged_by_where_their_mark_begins():
    rng = random.Random(4)
    for _ in range(3000):
        head = "".join(rng.choice("aab.!? \n`" if rng.random() < 0.5 else "abcde. ") for _ in range(20))
        assert M._cut_at(head) == safe_cut(head, 20)
