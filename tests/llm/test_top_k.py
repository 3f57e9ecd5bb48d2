import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.llm import top_k as tk

QUERY = "pmod(vec_id, 4) = 0"


def plain(rows, k, scale=1024):
    """(vec_id, vector) rows; queries have ids divisible by 4."""
    used = []
    for vec_id, x in rows:
        if vec_id is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            used.append((vec_id, [math.floor(v * scale) if abs(v) < 2**52 else int(v) * scale for v in x]))
    out = []
    for i, (query, q) in enumerate(used):
        if query % 4:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1), v_id) for j, (v_id, v) in enumerate(used) if j != i and len(v) == len(q)]
        out += [(query, n + 1, v_id, -s) for n, (s, v_id) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def cloud(n, dims, seed=1, centres=5):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centres, dims))
    return [(i, [float(v) for v in mid[i % centres] + 0.05 * rng.normal(size=dims)]) for i in range(n)]


CASES = {
    "cloud": cloud(600, 6),
    "flat and far": [(i, [float(i % 7), 0.0, -3.5]) for i in range(300)],
    "one vector": [(i, [0.25, -0.5]) for i in range(400)] + [(1000, [0.2, 0.2])],
    "repeated rows": [(0, [1.0, 2.0])] * 5 + [(0, [2.0, 1.0]), (4, [1.0, 2.0]), (3, [1.0, 2.0])] * 2,
    "odd": [(0, [1.0, None]), (1, None), (None, [1.0, 1.0]), (4, [float("nan"), 0.0]), (8, [float("inf"), 0.0]), (12, []), (16, []), (20, [1.0]), (24, [1.0, -1.0]), (28, [-1.0, 1.0]), (-4, [0.5, 0.5])],
    "huge": [(i, [2.0**40 * (i - 5), 3.0e20 * (i % 3 - 1)]) for i in range(12)] + [(20, [1e-9, 2.0**43])],
    "alone": [(0, [1.0])],
    "empty": [],
}
SMALL = tk.SearchParams(k=3, shard=40, block=16, leaf=4, sample=200, cells=8)


@pytest.mark.parametrize("name, params", [*((n, SMALL) for n in CASES), ("cloud", tk.SearchParams(k=5)), ("odd", tk.SearchParams())])
def test_against_brute_force(spark, name, params):
    df = spark.createDataFrame(CASES[name], "vec_id long, embedding array<double>").repartition(3)
    for c in ("code", "dims", "cell", "part", "kth", "score", "best"):
        df = df.withColumn(c, F.lit("x"))
    got = tk.exact_top_k(df, F.expr(QUERY), params=params)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain(CASES[name], params.k)


def test_best_first_leaves_out_what_bounds_rule_out():
    rng = random.Random(4)
    points = np.array([[rng.randrange(-900, 900) for _ in range(3)] for _ in range(2000)])
    points = np.unique(points, axis=0)
    tree = tk.grow(points, 16)
    for (start, end), low, high in zip(tree.span, tree.low, tree.high):
        assert (tree.points[start:end].min(axis=0) == low).all() and (tree.points[start:end].max(axis=0) == high).all()
    ids = [[i] for i in range(len(points))]
    q = np.array([[700, 300, -200], [1, 0, 0]])
    found = list(tk.best_first(tree, q, [None, None], ids, 5))
    for row, best in zip(q, found):
        want = sorted(((int(p @ row), -i) for i, p in enumerate(points)), reverse=True)[:5]
        assert sorted(((s, i) for s, i, _ in best), reverse=True) == want
    # A floor above all points ends the search at once; one at the best score keeps its ties.
    top = max(int(p @ q[0]) for p in points)
    assert list(tk.best_first(tree, q[:1], [top + 1], ids, 5)) == [[]]
    assert {s for s, _, _ in next(tk.best_first(tree, q[:1], [top], ids, 5))} == {top}


def test_codes():
    for x in ([], [0], [-32768, 32767], [32768], [2**31], [-(2**62) + 1]):
        assert tk.decode(tk.encode(np.array(x, "int64"))).tolist() == x
    assert tk.quantised(np.array([-0.0001, 0.5]), 1024).tolist() == [-1, 512]
    assert tk.decode(tk.encode(tk.quantised(np.array([1e300, 0.5]), 1024))).tolist() == [int(1e300) * 1024, 512]
