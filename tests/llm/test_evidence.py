"""Evidence of many passages that are each a little below chance."""

import math

from deskline.llm import toxic_segments


def test_all_segments_add_to_the_evidence():
    n = 100_000
    score = math.log(n) - 2.6  # with ln r summed, positive only well beyond r = 32
    assert toxic_segments._evidence([score] * 32, n, 1.0, 1.0) == 0
    assert toxic_segments._evidence([score] * 200, n, 1.0, 1.0) > 100
