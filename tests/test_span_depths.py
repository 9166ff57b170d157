"""Depths of span trees against a walk over every span."""

import random

import pytest

from ridgelog.operators.spantree import span_depths

SPAN = "trace_id string, span_id string, parent_id string"


def walk(rows):
    parent = {(t, s): (t, p) for t, s, p in rows}
    out = {}
    sizes = dict.fromkeys(parent, 0)
    for node in parent:
        path, at = [node], node
        while parent[at] in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        looped = parent[at] in parent
        circle = path[path.index(parent[at]) :] if looped else []
        for p in path if node not in circle else []:
            sizes[p] += 1
        out[node] = (None, None, node in circle) if looped else (len(path) - 1, at[1], False)
    return {k: (d, r, None if c else sizes[k], c) for k, (d, r, c) in out.items()}


def found(spark, rows):
    frame = span_depths(spark.createDataFrame(rows, SPAN))
    return {(r.trace_id, r.span_id): (r.depth, r.root_span_id, r.subtree_size, r.in_cycle) for r in frame.collect()}


def test_odd_trees(spark):
    rows = [("a", "1", ""), ("a", "2", "1"), ("a", "3", "2"), ("a", "4", None), ("a", "5", "gone"), ("a", "6", "5"), ("b", "1", "1"), ("b", "2", "1"), ("b", "3", "2")]
    rows += [("c", "1", "3"), ("c", "2", "1"), ("c", "3", "2"), ("c", "4", "2"), ("c", "5", "4"), ("c", "6", ""), ("d", "2", "1"), ("e", "", "x")]
    assert found(spark, rows) == walk(rows)
    assert found(spark, rows)[("c", "4")] == (None, None, 2, False)
    assert span_depths(spark.createDataFrame([], SPAN)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for t in range(20):
        n = rnd.choice([1, 2, 5, 40])
        for i in range(n):
            rows.append((f"t{t}", f"s{i}", rnd.choice(["", f"s{rnd.randrange(n)}", f"s{max(0, i - 1)}", "none"])))
    assert found(spark, rows) == walk(rows)


def test_long_chain(spark):
    n = 10_000
    rows = found(spark, [("t", str(i), str(i - 1) if i else "") for i in range(n)])
    assert rows == {("t", str(i)): (i, "0", n - i, False) for i in range(n)}
