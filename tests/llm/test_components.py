import random

import pytest

from pagelore.llm._common import components


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_equal_brute_force(spark, one_task):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)] + [(5, None), (6, 6)]
    low = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in range(400):
        for a, b in edges:
            if a in low and b in low and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task)
    assert {r.id: r.component for r in got.collect()} == low and got.count() == len(low)
    assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0
