"""The component search against a plain one, and the parts of a table that candidates are written in."""

import random

import pytest

from lamina.llm.graph import components
from lamina.llm.shared import appended, scratch_path


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def _cases():
    r = random.Random(5)
    ids = [r.randrange(-(1 << 62), 1 << 62) for _ in range(1500)]
    path = list(zip(ids, ids[1:]))
    tree = [(ids[i], ids[r.randrange(i)]) for i in range(1, 1500)]
    sparse = [(r.choice(ids), r.choice(ids)) for _ in range(900)]
    star = [(7, i) for i in range(3000)] * 2
    return {"path": path, "tree": tree, "sparse": sparse, "star": star, "loops": [(3, 3), (3, 4), (4, 3)], "none": []}


@pytest.mark.parametrize("name", _cases())
def test_components_equal_a_plain_search(spark, name):
    edges = _cases()[name]
    random.Random(6).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    got = [(r.node, r.root) for r in components(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == plain(edges)


def test_parts_of_a_table_are_read_in_few_tasks(spark):
    path = scratch_path(spark, "parts")
    for i in range(20):
        appended(spark.range(i * 100, i * 100 + 100).repartition(4), path)
    rows = spark.read.schema("id long").parquet(path)
    assert rows.selectExpr("count(distinct id)").first()[0] == 2000
    assert rows.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
