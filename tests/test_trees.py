"""Boosted trees against a plain reading of the method, whatever the cut of the rows; and as a part of every search."""

import numpy as np
import pytest

from evenhand.operators import models as L
from evenhand.operators import search as S
from evenhand.operators import trees as T
from evenhand.plans import learn


def made(n=400, k=6, seed=3):
    rnd = np.random.default_rng(seed)
    z = rnd.normal(size=(n, k))
    y = (z[:, 0] * z[:, 1] + z[:, 2] + 0.5 * rnd.normal(size=n) > 0).astype(int)
    w = rnd.choice([0.5, 1.0, 2.0], n)
    return T.to_bins(z, T.bins_of_cells(T.count_cells(z))), y, w, rnd.integers(0, 2**32, n, dtype=np.uint32)


def rows_of(bins, y, w, h, pieces=1, room=T.ROOM):
    out = T.Rows(room)
    for part in np.array_split(np.arange(len(y)), pieces):
        out.add(bins[:, part], (w * (2 * y - 1))[part].astype(np.float32), h[part])
    return out


def plainly(bins, y, w, h, leaves, trees, rate=0.03, least=10):
    """Scores after every tree: all splits of all leaves are tried, one by one."""
    k, rnd = len(bins), np.random.default_rng(1)
    f = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    for t in range(trees):
        cols = np.sort(rnd.permutation(k)[: k // 2])
        bag, p = T._bag(h, t, 1, 0.8), 1 / (1 + np.exp(-f))
        g, c = w * (p - y), w * p * (1 - p)
        node = np.zeros(len(y), int)
        for new in range(1, leaves):
            best = (1e-9, None)
            for leaf in range(new):
                own = bag & (node == leaf)
                for j in cols:
                    for edge in range(T.BINS - 1):
                        a, b = own & (bins[j] <= edge), own & (bins[j] > edge)
                        if min(a.sum(), b.sum()) >= least:
                            gain = g[a].sum() ** 2 / c[a].sum() + g[b].sum() ** 2 / c[b].sum() - g[own].sum() ** 2 / c[own].sum()
                            if gain > best[0] * (1 + 1e-6):
                                best = gain, (leaf, j, edge)
            if best[1] is None:
                break
            leaf, j, edge = best[1]
            node[(node == leaf) & (bins[j] > edge)] = new
        if node.any():
            f = f - rate * np.array([g[bag & (node == i)].sum() / max(c[bag & (node == i)].sum(), 1e-300) for i in range(leaves)])[node]
    return f


@pytest.mark.parametrize("leaves", [4, 8])
def test_trees_are_those_of_a_plain_reading(leaves):
    case = made()
    m = T.grow(rows_of(*case), leaves, trees=6)
    assert m(case[0]) == pytest.approx(plainly(*case, leaves, 6), abs=1e-5)
    assert (m.splits[:, :, 0] >= 0).all()


def test_no_cut_of_the_rows_changes_a_tree(monkeypatch):
    case = made()
    want = T.grow(rows_of(*case), 8, trees=20)
    order = np.random.default_rng(0).permutation(400)
    mixed = case[0][:, order], *(a[order] for a in case[1:])
    monkeypatch.setattr(T, "BLOCK", 64)
    for room, flat in ((T.ROOM, T.FLAT), (0, 16)):  # in memory, and all of it in a file with columns counted in pairs
        monkeypatch.setattr(T, "FLAT", flat)
        rows = rows_of(*mixed, pieces=30, room=room)
        got = T.grow(rows, 8, trees=20)
        assert len(rows.blocks) == 7 and sum(len(b.signed) for b in rows.blocks) == 400
        assert isinstance(rows.blocks[0].bins, np.memmap) == (room == 0)
        assert (got.splits == want.splits).all() and (got.values == want.values).all()


def test_trees_of_one_class_or_without_columns_are_the_prior():
    bins, y, w, h = made(50)
    assert not T.grow(rows_of(bins, y * 0, w, h), 4).values.any()
    assert T.grow(rows_of(bins[:0], y, w, h), 4)(bins[:0]) == pytest.approx(np.full(50, np.log((w * y).sum() / (w * (1 - y)).sum())), abs=1e-6)


def test_cells_and_bins_keep_the_order_of_values():
    z = np.r_[-1e300, -50, np.random.default_rng(0).normal(size=5000), 50, 1e300][:, None]
    bins = T.to_bins(z, T.bins_of_cells(T.count_cells(z)))[0]
    assert (np.diff(bins[np.argsort(z[:, 0], kind="stable")].astype(int)) >= 0).all() and len(set(bins)) == T.BINS
    assert np.bincount(bins).max() < 2 * len(z) / T.BINS


# ---- in the search ------------------------------------------------------------------------------------------
GRID = [{"candidate": 0, "kind": "logreg", "k": 3, "setting": 0.1}, {"candidate": 1, "kind": "gbt", "k": 2, "setting": 4.0}, {"candidate": 2, "kind": "gbt", "k": 5, "setting": 8.0}]


@pytest.fixture(scope="module")
def wide(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(240, 6))
    rows = [(i, "ab"[i % 2], int(v[0] * v[1] + 0.3 * v[2] + 0.3 * rnd.normal() > 0), [float(e) for e in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key int, site string, y int, features array<double>")


def test_every_setting_of_the_grid_is_searched():
    assert learn.GRID == L.candidate_grid() and sum(g["kind"] == "gbt" for g in learn.GRID) == 6


@pytest.mark.parametrize("name", ["inner_surface", "nested_cv", "fit_once_predict"])
def test_registered_searches_take_the_whole_grid(spark, name, monkeypatch):
    from evenhand.plans import catalog

    class Asked(Exception):
        pass

    def asked(plan, grid, *a, **k):
        raise Asked(list(grid))

    monkeypatch.setattr(S, "search", asked)
    with pytest.raises(Asked) as e:
        catalog()[name].build(spark, "/root/testdata/sf0.001")
    assert e.value.args[0] == L.candidate_grid()


def test_nested_search_chooses_among_boosted_trees(spark, wide):
    plan = S.pooled_plan(wide, seeds=(1,), k=3, inner=2)
    found = S.search(plan, GRID)
    surface = found.surface.toPandas()
    assert set(surface["candidate"]) == {0, 1, 2} and len(surface) == 3 * 2 * 3 and surface["sb_auc"].between(0, 1).all()
    mean = surface.groupby(["fold", "candidate"])["sb_auc"].mean()
    chosen = found.chosen.where("kind = 'gbt'").toPandas().set_index("fold")["candidate"]
    assert all(mean[f, chosen[f]] == mean[f][[1, 2]].max() for f in range(3))
    # the outer scores are those of trees grown on the outer training rows alone
    rows = plan.rows.selectExpr("key", "site", "y", "x", "v", "conv(substring(md5('1|' || key), 1, 15), 16, 10) AS h").toPandas()
    x, v = np.stack(rows["x"].to_numpy()), np.stack(rows["v"].to_numpy())
    site, y = rows["site"].map(found.made.sites).to_numpy(), rows["y"].to_numpy()
    h = rows["h"].astype(np.uint64).to_numpy().astype(np.uint32)
    outer = found.outer.where("kind = 'gbt'").toPandas().set_index(["fold", "role", "key"])["score"]
    for f in range(3):
        g = GRID[chosen[f]]
        cols = found.made.columns(f * 3, g["k"])
        z = found.made.z(f * 3, x, site)[:, cols]
        tr = v[:, f] >= 0
        bins = T.to_bins(z, T.bins_of_cells(T.count_cells(z[tr])))
        score = T.grow(rows_of(bins[:, tr], y[tr], found.made.weight[f * 3, site, y][tr], h[tr]), int(g["setting"]))(bins)
        want = {(f, "train" if t else "test", k): s for t, k, s in zip(tr, rows["key"], score)}
        assert outer[outer.index.get_level_values("fold") == f].to_dict() == {k: pytest.approx(s, abs=1e-9) for k, s in want.items()}
    ens = S.ensemble(found.outer, ["seed", "fold"]).toPandas()
    assert len(ens) == 240
    z = found.outer.toPandas()
    at = [z["fold"], z["kind"]]
    train = z["score"].where(z["role"] == "train").groupby(at)
    z["z"] = (z["score"] - train.transform("mean")) / (train.transform("std", ddof=0) + 1e-8)
    z = z[z["role"] == "test"].groupby("key")["z"].mean()
    assert ens.set_index("key")["score"].to_dict() == {k: pytest.approx(s, abs=1e-9) for k, s in z.items()}


def test_locked_rows_are_scored_by_boosted_trees_too(wide):
    dev, new = wide.where("key < 180"), wide.where("key >= 180").drop("y")
    got = S.locked_scores(dev, new, {"all": "features"}, GRID[1:], inner=2).toPandas().set_index("key")["score"]
    y = wide.where("key >= 180").toPandas().set_index("key")["y"]
    assert len(got) == 60 and got[y[y == 1].index].mean() - got[y[y == 0].index].mean() > 0.5  # a product, which no line tells
