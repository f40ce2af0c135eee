"""The neighbour index against brute force."""

import numpy as np
import pytest

from evenhand.operators import joins, neighbours


def clustered(n=900, p=16, seed=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(60, p)) * 2
    x = centres[rnd.integers(0, 60, n)] + 0.4 * rnd.normal(size=(n, p))
    x[:300] = x[0]  # a third of all rows are one vector
    return x


def nearest(x, site, i, same):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    d[i] = np.inf
    return d[(site == site[i]) == same].min(initial=np.inf)


def test_index_finds_nine_in_ten_and_never_errs(spark):
    x = clustered()
    site = np.array([["p", "q", ""][i * 7 % 3] for i in range(len(x))])
    df = spark.createDataFrame([(f"k{i}", s, [float(v) for v in r], 1) for i, (s, r) in enumerate(zip(site, x))], "name string, place string, v array<double>, key int")
    found = neighbours.indexed_neighbours(df, "name", "place", "v", bucket_rows=64)
    got = {r["key"]: r for r in found.collect()}
    assert len(got) == len(x)
    hits = {"within": 0, "across": 0}
    for i in range(len(x)):
        r = got[f"k{i}"]
        for side, same in (("within", True), ("across", False)):
            true = nearest(x, site, i, same)
            assert r[f"d_{side}"] is None or r[f"d_{side}"] >= true - 1e-9
            if r[f"d_{side}"] is not None:
                j = int(r[f"nn_{side}"][1:])
                assert (site[j] == site[i]) == same and j != i and np.linalg.norm(x[i] - x[j]) == pytest.approx(r[f"d_{side}"], abs=1e-9)
                hits[side] += r[f"d_{side}"] <= true + 1e-9
    assert min(hits.values()) >= 0.9 * len(x)
    table = {r["side"]: r for r in neighbours.recall(df, found, "name", "place", "v", sample=2000).collect()}
    assert all(table[s]["n"] == len(x) and table[s]["n_found"] == hits[s] for s in hits)


def test_one_bucket_is_exact(spark):
    x = clustered(120)
    df = spark.createDataFrame([(i, "ab"[i % 2], [float(v) for v in r]) for i, r in enumerate(x)], "key long, site string, f array<double>")
    a = {r["key"]: (r["d_within"], r["d_across"]) for r in neighbours.indexed_neighbours(df, "key", "site", "f", tables=1).collect()}
    b = {r["key"]: (r["d_within"], r["d_across"]) for r in joins.nearest_neighbours(df, "key", "site", "f").collect()}
    assert a == {k: pytest.approx(v, abs=1e-9) for k, v in b.items()}


def test_odd_rows(spark):
    rows = [(1, "a", [0.0, 1.0]), (2, "a", None), (3, "a", [None, 1.0]), (4, "b", [0.0, 3.0]), (5, None, [float("nan"), 0.0]), (None, "a", [0.0, 1.5]), (1, "a", [0.0, 9.0])]
    df = spark.createDataFrame(rows, "key int, site string, f array<double>")
    got = {(r["key"], r["d_within"], r["d_across"]) for r in neighbours.indexed_neighbours(df, "key", "site", "f").collect()}
    assert got == {(1, 0.5, 2.0), (2, None, None), (3, None, None), (4, None, 1.5), (5, None, None), (None, 0.5, 1.5), (1, 7.5, 6.0)}
    empty = neighbours.indexed_neighbours(df.where("key > 9"), "key", "site", "f")
    assert empty.count() == 0 and neighbours.recall(df.where("key > 9"), empty, "key", "site", "f").count() == 0


def test_exact_mode_takes_text_keys(spark):
    df = spark.createDataFrame([("x", "a", [0.0]), ("y", "a", [1.0]), ("z", "b", [3.0])], "key string, site string, f array<double>")
    assert {(r["key"], r["nn_within"], r["nn_across"]) for r in joins.nearest_neighbours(df, "key", "site", "f").collect()} == {("x", "y", "z"), ("y", "x", "z"), ("z", None, "y")}


def test_exact_mode_moves_a_row_once_per_pair_of_blocks(spark):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(size=(150, 3)), rnd.normal(size=(150, 3)) + 1000])
    x[20:26] = x[20]
    key, site = np.arange(300) // 2 * 2, [["a", "b", None][i % 7 % 3] for i in range(300)]  # two rows of each key
    df = spark.createDataFrame([(int(k), s, [float(v) for v in r]) for k, s, r in zip(key, site, x)] + [(900, "a", None)], "key long, site string, f array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[key[:, None] == key] = np.inf
    same = np.array([[a == b for b in site] for a in site])
    want = sorted(round(float(np.where(m, d, np.inf)[i].min()), 6) for i in range(300) for m in (same, ~same))
    for size in (16, 64, 1000):
        got = joins.nearest_neighbours(df, "key", "site", "f", size).collect()
        assert len(got) == 300 and sorted(round(v, 6) for r in got for v in (r["d_within"], r["d_across"])) == want
    plan = joins.nearest_neighbours(df, "key", "site", "f")._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan
