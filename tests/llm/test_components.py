import random

import pytest
from bytestrata.llm import components
from bytestrata.llm.components import connected_components
from bytestrata.llm.scratch import Scratch

R = random.Random(3)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(40)],
    "random": [(R.randrange(200), R.randrange(200)) for _ in range(150)],
    "self-loop only": [(5, 5)],
    "two hubs, repeated edges": [(0, i) for i in range(1, 50)] * 2 + [(60, i) for i in range(40, 59)],
}


@pytest.mark.parametrize("run", [2, components.TASK_EDGES])
@pytest.mark.parametrize("name", GRAPHS)
def test_equals_union_find(spark, monkeypatch, name, run):
    monkeypatch.setattr(components, "TASK_EDGES", run)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in GRAPHS[name]:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = [tuple(r) for r in connected_components(spark.createDataFrame(GRAPHS[name], "u long, v long"), Scratch(spark, "t")).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == {x: find(x) for x in list(root)}
