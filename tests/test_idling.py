import random

import pytest

from roadlake.operators import idling
from tests.helpers import fixes, fold_idling, gps_frame


@pytest.mark.parametrize("seed, size", [(1, 3600), (2, 10**6), (3, 60), (4, 1000), (5, 7200)])
def test_fold(spark, seed, size):
    rng = random.Random(seed)
    rows = fixes(rng, 1, 700, 60 * 3600) + [(f"x{r[0]}", *r[1:]) for r in fixes(rng, 3, 50, 60 * 3600)]
    frame = gps_frame(spark, rows)
    got = sorted(tuple(r) for r in idling.idling_episodes(frame, span_seconds=size).collect())
    expected = fold_idling(frame.collect())
    assert [(*r[:2], *r[3:]) for r in got] == [(*r[:2], *r[3:]) for r in expected]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in expected])
    assert any(r[5].date() != r[6].date() for r in expected)
