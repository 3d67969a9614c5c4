import math

import numpy as np
import pytest

from tessera.llm import embedding_dedup as E

rng = np.random.default_rng(3)


def plain(rows):
    ok = [v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and any(v) for _, v in rows]
    units = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if good else None for (_, v), good in zip(rows, ok)]
    n = len(rows)
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return out


def vectors():
    rows = []
    for _ in range(30):
        centre = rng.normal(size=12)
        rows += [(centre + rng.normal(size=12) * 0.12).tolist() for _ in range(rng.integers(1, 9))]
    rows += [rows[0]] * 3 + [[0.0] * 12, None, [], [float("nan")] * 12, [None] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [math.inf] + [0.0] * 11]
    rows += [(np.array(rows[5]) * 1e-3).tolist()]
    order = rng.permutation(len(rows))
    return [(int(k), rows[i]) for k, i in enumerate(order)] + [(None, rows[0]), (3, rows[1])]


@pytest.mark.parametrize(("block", "leaf"), [(4096, 512), (16, 4), (7, 30)])
def test_matches_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(E, "OUTRIGHT", leaf)
    rows = vectors()
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<double>, v int, node int")
    found = E.near_duplicates(frame, block=block, leaf=leaf)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows), key=str)


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in E.near_duplicates(one).collect()] == [(4, 0, 4, True)]


def test_recursion_finds_all_links():
    x = E.unit(rng.normal(size=(900, 3)))
    p = x[:, :2]
    left, _, label = E.compare(x, None, p, p, (np.ones(900), np.ones(900)), 0.99, math.sqrt(0.02) + 1e-6)
    assert left.tolist() == ((x @ x.T >= 0.99).sum(1) - 1).tolist()
    y = E.unit(rng.normal(size=(700, 3)))
    left, right, label = E.compare(x, y, p, y[:, :2], (np.ones(900), np.ones(700)), 0.99, math.sqrt(0.02) + 1e-6)
    assert left.tolist() == (x @ y.T >= 0.99).sum(1).tolist() and right.tolist() == (x @ y.T >= 0.99).sum(0).tolist()


def test_distant_leaves_are_not_sent(spark):
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + rng.normal(size=16) * 0.01).tolist()) for k in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id AS node", "1L AS copies", "embedding AS v")
    reach = math.sqrt(2 - 2 * E.COSINE) + E.SLACK
    leaves = E.saved(E.grid_ordered(frame, reach, E.directions(frame, 4000), 64), "leaves")
    leaves = E.numbered(leaves, 512)
    count = {r.block: r["count"] for r in leaves.groupBy("block").count().collect()}
    assert sorted(r.leaf for r in leaves.select("leaf").collect()) == list(range(sum(count.values())))
    boxes = leaves.select("block", "size", "lo", "hi")
    pairs = E.saved(E.near_intervals(boxes, reach), "pairs")
    sent = E.needed_leaves(pairs, leaves.select("block", "leaf", "size", "lo", "hi"), reach).count()
    assert sent < 0.5 * sum(count[r.a] + (count[r.b] if r.b != r.a else 0) for r in pairs.collect())
