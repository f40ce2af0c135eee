"""The batched search against plain numpy, context by context."""

import numpy as np
import pytest

from evenhand.operators import harmonise as H
from evenhand.operators import models as L
from evenhand.operators import search as S
from evenhand.operators import selection as R

P, SITES = 7, ["a", "b|1", ""]


@pytest.fixture(scope="module")
def case(spark):
    return made_case(spark, 0.08)


def made_case(spark, share):
    """(wide rows, plan): few rows of three sites, a share of values missing, one column constant, one a copy."""
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(150):
        x = rnd.normal(size=P) + i % 3
        y = int(x[0] + rnd.normal() > 1)
        x[3], x[5] = x[1] * 2 + rnd.normal() * 0.01, 4.0
        x = [None if share and j in (2, 6) and rnd.random() < share else float(v) for j, v in enumerate(x)]
        rows.append((i, SITES[i % 3], y, x))
    wide = spark.createDataFrame(rows, "key int, site string, y int, features array<double>")
    return rows, S.pooled_plan(wide, seeds=(3, 8), k=3, inner=2)


def splits(plan):
    """Per context the keys of both roles."""
    v = {r["key"]: r["v"] for r in plan.rows.select("key", "v").collect()}
    out = {}
    for ctx in range(plan.contexts()):
        slot, i = divmod(ctx, plan.inner + 1)
        i -= 1
        out[ctx] = ([k for k, o in v.items() if o[slot] >= 0 and (i < 0 or o[slot] != i)], [k for k, o in v.items() if o[slot] == i])
    return out


def test_slots_are_stratified_and_disjoint(case):
    rows, plan = case
    parts = splits(plan)
    for slot in range(len(plan.slots)):
        base = slot * (plan.inner + 1)
        train, test = parts[base]
        assert sorted(train + test) == list(range(150))
        inner = [parts[base + 1 + i] for i in range(plan.inner)]
        assert sorted(k for _, t in inner for k in t) == sorted(train)
        assert all(sorted(a + b) == sorted(train) for a, b in inner)
    for seed in range(2):
        assert sorted(k for f in range(3) for k in parts[(seed * 3 + f) * (plan.inner + 1)][1]) == list(range(150))


@pytest.mark.parametrize("harm, share", [("none", 0.0), ("combat", 0.08), ("balanced_combat", 0.08)])
def test_prepared_values_order_and_weights(spark, case, harm, share):
    rows, plan = case if share else made_case(spark, share)
    made, parts = S.prepare(plan, harm, kmax=4), splits(plan)
    long = [(c, k, role, rows[k][1], rows[k][2], j, v) for c in (0, 1, 5) for role, ks in zip(("train", "test"), parts[c]) for k in ks for j, v in enumerate(rows[k][3])]
    df = spark.createDataFrame(long, "ctx int, key int, role string, site string, y int, feature int, value double")
    z = H.fit_apply(df, ["ctx"], harm)
    want = {(r["ctx"], r["key"], r["feature"]): r["value"] for r in z.collect()}
    train = H.train_rows(z)
    ids = {c: sorted({f for (x, _, f) in want if x == c}) for c in (0, 1, 5)}
    for c in (0, 1, 5):
        assert list(made.full[c]) == ids[c] and 5 not in ids[c]
        x = np.array([[np.nan if v is None else v for v in rows[k][3]] for k in range(150)])
        got = made.z(c, x, np.array([made.sites[r[1]] for r in rows]))
        for (ctx, k, f), v in want.items():
            if ctx == c:
                assert got[k, f] == pytest.approx(v, abs=1e-8)
        one = train.where(f"ctx = {c}")
        corr = R.abs_corr_matrix(H.to_vectors(one, ["key"]), "values")
        named = [(ids[c][r["i"]], ids[c][r["j"]], r["r"]) for r in corr.collect()]
        order = R.corr_prune_topk(R.within_site_auc_rank(one), spark.createDataFrame(named, "i int, j int, r double"), [], 0.9, 4)
        assert list(made.order[c]) == [r["feature"] for r in order.orderBy("position").collect()]
        n = {}
        for k in parts[c][0]:
            n[rows[k][1], rows[k][2]] = n.get((rows[k][1], rows[k][2]), 0) + 1
        for (s, y), m in n.items():
            assert made.weight[c, made.sites[s], y] == pytest.approx(len(parts[c][0]) / (len(n) * m))


GRID = [{"candidate": 4, "kind": "logreg", "k": 3, "setting": 1.0}, {"candidate": 7, "kind": "ridge_all", "k": 0, "setting": 0.05}, {"candidate": 9, "kind": "svm", "k": 2, "setting": 1.0},
        {"candidate": 11, "kind": "logreg", "k": 0, "setting": 0.5, "target": "b|1", "plain": True}]


def test_fits_are_at_their_optimum(case):
    rows, plan = case
    made, _ = S.share(plan, GRID, "combat", kmax=4, landmarks=30)
    beta, parts = S.fit_all(plan, made, GRID, steps={"svm": 200, "logistic": 30}, tolerance={"svm": 1e-9, "logistic": 1e-9}), splits(plan)
    x = np.array([[np.nan if v is None else v for v in r[3]] for r in rows])
    site, y = np.array([made.sites[r[1]] for r in rows]), np.array([r[2] for r in rows])
    for ctx in (0, 4):
        tr = parts[ctx][0]
        z = made.z(ctx, x[tr], site[tr])
        for c, g in enumerate(GRID):
            a = S.Designs(made, ctx, z).of(g["kind"], g["k"])
            own = (site[tr] == made.sites["b|1"]).astype(int) if "target" in g else y[tr]
            w = np.ones(len(tr)) if "plain" in g else made.weight[ctx, site[tr], y[tr]]
            b = beta[ctx, c]

            def value(b):
                return g["setting"] * S._terms(g["kind"], a @ b, own, w)[0].sum() + 0.5 * b[:-1] @ b[:-1]

            best, rnd = value(b), np.random.default_rng(ctx)
            for size in (1e-1, 1e-2, 1e-3):
                for _ in range(40):
                    assert value(b + size * rnd.normal(size=len(b))) > best - 2e-4 * abs(best)
            if g["kind"] != "svm":
                grad = g["setting"] * a.T @ (w * (1 / (1 + np.exp(-a @ b)) - own)) + np.r_[b[:-1], 0]
                assert np.abs(grad).max() < 1e-5


def test_kernel_machine_agrees_with_the_exact_dual(spark):
    """With every row a landmark the features carry the whole kernel, so the margin is the dual solution's."""
    rnd = np.random.default_rng(2)
    rows = [(i, "s", int(x[0] ** 2 + x[1] + 0.6 * rnd.normal() > 0.7), [float(v) for v in x]) for i, x in enumerate(rnd.normal(size=(60, 2)))]
    plan = S.pooled_plan(spark.createDataFrame(rows, "key int, site string, y int, features array<double>"), seeds=(1,), k=3, inner=2)
    grid = [{"candidate": 0, "kind": "svm", "k": 2, "setting": 2.0}]
    made, shared = S.share(plan, grid, "none", landmarks=100)
    beta = S.fit_all(plan, made, grid, shared, [0], steps={"svm": 400, "logistic": 30}, tolerance={"svm": 1e-12, "logistic": 1e-9})
    tr = splits(plan)[0][0]
    x, y = np.array([rows[k][3] for k in tr]), np.array([rows[k][2] for k in tr])
    z = made.z(0, x, np.zeros(len(tr), int))
    w = made.weight[0, 0, y]
    got = S.Designs(made, 0, z).of("svm", 2) @ beta[0, 0]
    # exact dual by cyclic pair updates
    t, cap = 2.0 * y - 1, 2.0 * w
    k = S.kernel(z[:, made.columns(0, 2)], z[:, made.columns(0, 2)], 0.5)
    alpha = np.zeros(len(t))
    for _ in range(20_000):
        g = t - k @ (alpha * t)  # violation of the optimality conditions, by the most violating pair
        up = ((t > 0) & (alpha < cap - 1e-12)) | ((t < 0) & (alpha > 1e-12))
        low = ((t < 0) & (alpha < cap - 1e-12)) | ((t > 0) & (alpha > 1e-12))
        i, j = np.flatnonzero(up)[g[up].argmax()], np.flatnonzero(low)[g[low].argmin()]
        if g[i] - g[j] < 1e-7:
            break
        step = (g[i] - g[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, cap[i] - alpha[i] if t[i] > 0 else alpha[i], alpha[j] if t[j] > 0 else cap[j] - alpha[j])
        alpha[i] += t[i] * step
        alpha[j] -= t[j] * step
    want = k @ (alpha * t) + (g[i] + g[j]) / 2
    assert np.abs(got - want).max() < 0.05 and np.corrcoef(got, want)[0, 1] > 0.9995


def test_search_chooses_and_scores(spark, case):
    from evenhand.operators.metrics import site_balanced_auc

    rows, plan = case
    grid = [{"candidate": i, "kind": "logreg", "k": k, "setting": c} for i, (k, c) in enumerate([(1, 0.1), (4, 0.1), (4, 5.0)])] + [{"candidate": 3, "kind": "ridge_all", "k": 0, "setting": 0.01}]
    found = S.search(plan, grid, kmax=4)
    surface = {}
    for r in found.surface.collect():
        surface.setdefault((r["seed"], r["fold"], r["kind"], r["candidate"]), []).append(r["sb_auc"])
    assert len(surface) == 6 * 4 and all(len(v) == 2 for v in surface.values())
    for r in found.chosen.collect():
        mine = {c: np.mean(v) for (s, f, k, c), v in surface.items() if (s, f, k) == (r["seed"], r["fold"], r["kind"])}
        assert mine[r["candidate"]] == pytest.approx(max(mine.values()), abs=1e-9) and r["inner_mean"] == pytest.approx(mine[r["candidate"]])
    outer = found.outer.where("role = 'test'").groupBy("seed", "kind", "key").count()
    assert outer.count() == 2 * 2 * 150 and outer.agg({"count": "max"}).first()[0] == 1
    both = S.with_ensemble(found.outer, ["seed", "fold"])
    table = {(r["model"], r["metric"]): r for r in S.seed_summary(both, b=50).collect()}
    per = [r["sb_auc"] for r in site_balanced_auc(both.where("model = 'ensemble'"), by=["seed"]).collect()]
    got = table["ensemble", "sb_auc"]
    assert got["mean"] == pytest.approx(np.mean(per)) and got["sd"] == pytest.approx(np.std(per, ddof=1)) and got["lo"] <= got["seed_avg"] <= got["hi"]
    assert got["mean"] > 0.7 and table["logreg", "auc_a"]["lo"] is None and len(table) == 3 * 5


def test_a_site_held_out_is_mapped_by_its_own_moments(spark, case):
    rows, _ = case
    wide = spark.createDataFrame(rows, "key int, site string, y int, features array<double>")
    plan = S.held_out_plan(wide, seeds=(1, 2), inner=2)
    made = S.prepare(plan, kmax=4)
    x = np.array([[np.nan if v is None else v for v in r[3]] for r in rows])
    site = np.array([r[1] for r in rows])
    for i, slot in enumerate(plan.slots):
        own = site == slot["held_out"]
        z = made.z(i * 3, x[own], np.full(own.sum(), made.sites[slot["held_out"]]))[:, made.full[i * 3]]
        other = np.concatenate([made.z(i * 3, x[site == s], np.full((site == s).sum(), made.sites[s]))[:, made.full[i * 3]] for s in SITES if s != slot["held_out"]])
        assert np.abs(z.mean(0) - other.mean(0)).max() < 0.2
    found = S.held_out_auc(S.search(plan, GRID[:2], kmax=4).outer).collect()
    assert len(found) == 6 and {r["n"] for r in found} == {50} and all(r["auc"] > 0.6 for r in found)


def test_sites_told_apart_before_and_not_after_harmonising(case):
    rows, plan = case
    before, after = (np.mean([r["site_leak_auc"] for r in S.site_leak(plan, h).collect()]) for h in ("none", "combat"))
    assert before > 0.8 and after < before
    d = S.domain_classifier(plan).collect()
    assert {r["target"] for r in d} == set(SITES) and all(r["chosen_c"] in (0.01, 0.1, 1.0) for r in d)
    # the sites lie on a line: only its ends can be told apart by one
    assert all(r["pooled_auc"] > 0.8 for r in d if r["target"] != "b|1")


def test_locked_rows_take_part_by_their_moments_only(spark, case):
    rows, _ = case
    wide = spark.createDataFrame(rows, "key int, site string, y int, features array<double>").selectExpr("*", "slice(features, 1, 3) AS low")
    got = S.locked_scores(wide.where("site <> 'a'"), wide.where("site = 'a'").drop("y"), {"all": "features", "low": "low"}, GRID[:2], inner=2).collect()
    s = np.array([r["score"] for r in got])
    assert len(got) == 50 and abs(s.mean()) < 1e-9
    y = np.array([rows[r["key"]][2] for r in got])
    assert s[y == 1].mean() > s[y == 0].mean()


def test_grid_has_its_29_settings_in_order():
    grid = L.candidate_grid()
    assert len(grid) == 29 and [g["candidate"] for g in grid] == list(range(29)) and {g["kind"] for g in grid[:9]} == {"logreg"}


def test_sparse_fits_meet_the_optimality_conditions(case):
    rows, plan = case
    c, l1 = 0.2, 0.7
    made, shared = S.share(plan, [], "none")
    grid = [{"candidate": 0, "kind": "logreg", "k": 0, "setting": c, "l1": l1}, {"candidate": 1, "kind": "logreg", "k": 0, "setting": 0.001, "l1": 1.0}]
    ctx, parts = 0, splits(plan)
    beta = S.fit_all(plan, made, grid, shared, [ctx], tolerance={"svm": 1e-5, "logistic": 1e-12})
    tr = parts[ctx][0]
    x = np.array([[np.nan if v is None else v for v in rows[k][3]] for k in tr])
    site, y = np.array([made.sites[rows[k][1]] for k in tr]), np.array([rows[k][2] for k in tr])
    a = S.Designs(made, ctx, made.z(ctx, x, site)).of("logreg", 0)
    b = beta[ctx, 0]
    grad = c * a.T @ (made.weight[ctx, site, y] * (1 / (1 + np.exp(-a @ b)) - y)) + np.r_[(1 - l1) * b[:-1], 0.0]
    on = b[:-1] != 0
    assert 0 < on.sum() < len(on) and abs(grad[-1]) < 1e-6
    assert np.allclose(grad[:-1][on], -l1 * np.sign(b[:-1][on]), atol=1e-6) and (np.abs(grad[:-1][~on]) <= l1 + 1e-6).all()
    assert not beta[ctx, 1][:-1].any()
    table = S.lasso_select(plan, c, l1).where("seed = 3 AND fold = 0").collect()
    assert {r["feature"]: pytest.approx(r["coef"], abs=1e-5) for r in table} == {f: v for f, v in zip(made.full[ctx].tolist(), b) if v}


def test_capped_net_keeps_few_and_falls_back_to_the_prior(case):
    rows, plan = case
    some = S.capped_elastic_net(plan, 1.0, 0.5, cap=2).collect()
    assert len(some) == 2 * 150 and {r["n_selected"] for r in some} == {2}
    none = S.capped_elastic_net(plan, 1e-5, 1.0).where("seed = 3 AND fold = 0").collect()
    assert {r["n_selected"] for r in none} == {0} and len({round(r["score"], 6) for r in none}) == 1 and abs(none[0]["score"]) < 1e-6


def test_transport_against_numpy(spark, case):
    rows, _ = case
    wide = spark.createDataFrame(rows, "key int, site string, y int, features array<double>")
    plan = S.transport_plan(wide, [("a", "b|1"), ("b|1", "")], inner=2)
    grid = [{"candidate": 0, "kind": "logreg", "k": 2, "setting": 0.1}, {"candidate": 1, "kind": "logreg", "k": 4, "setting": 1.0}, {"candidate": 2, "kind": "ridge_all", "k": 0, "setting": 0.01}]
    got = {(r["source"], r["target"], r["mapping"]): r for r in S.transport(plan, grid, em_steps=4).collect()}
    assert len(got) == 2 * 7
    found = S.search(plan, grid, "none")
    x = np.array([[np.nan if v is None else v for v in r[3]] for r in rows])
    site, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for i, slot in enumerate(plan.slots):
        ctx, s, t = i * 3, site == slot["source"], site == slot["target"]
        made = found.made
        xs, xt = (np.where(np.isnan(x[m]), made.fill[ctx], x[m]) for m in (s, t))
        ys, yt = y[s], y[t]
        mul, add = made.mul[ctx, made.sites[slot["source"]]], made.add[ctx, made.sites[slot["source"]]]

        def soft(v, w):
            m1, m0 = np.average(v, axis=0, weights=w), np.average(v, axis=0, weights=1 - w)
            return (m1 + m0) / 2, (w[:, None] * (v - m1) ** 2 + (1 - w[:, None]) * (v - m0) ** 2).mean(0)

        loc, var = soft(xs, ys.astype(float))
        delta = xs[ys == 1].mean(0) - xs[ys == 0].mean(0)

        def run(values):
            z, out, prob = values * mul + add, [], None
            for c in found.wanted[i][2]:
                cols = made.columns(ctx, grid[c]["k"])
                b = found.beta[ctx, c]
                f = lambda q: q[:, cols] @ b[:-1] + b[-1]
                tr = f(xs * mul + add)
                out.append((f(z) - tr.mean()) / (tr.std() + 1e-8))
                if grid[c]["kind"] == "logreg":
                    prob = 1 / (1 + np.exp(-f(z)))
            return np.mean(out, axis=0), prob

        def moved(l, v):
            return (xt - l) / np.sqrt(np.maximum(v, 1e-12)) * np.sqrt(np.maximum(var, 1e-12)) + loc

        def by_prior(pi):
            r = np.sqrt(np.maximum(xt.var(0), 1e-12) / np.maximum(var + pi * (1 - pi) * delta**2, 1e-12))
            return (xt - (xt.mean(0) - (pi - 0.5) * r * delta)) / r + loc

        want = {"none": xt, "combat": moved(xt.mean(0), xt.var(0)), "oracle": moved(*soft(xt, yt.astype(float))), "prior_known": by_prior(yt.mean()),
                "prior_minus": by_prior(np.clip(yt.mean() - 0.15, 0.02, 0.98)), "prior_plus": by_prior(np.clip(yt.mean() + 0.15, 0.02, 0.98))}
        now = want["combat"]
        for _ in range(4):
            p, pi = np.clip(run(now)[1], 1e-6, 1 - 1e-6), 0.5
            for _ in range(100):
                q = pi / 0.5 * p / (pi / 0.5 * p + (1 - pi) / 0.5 * (1 - p))
                old, pi = pi, q.mean()
                if abs(pi - old) < 1e-6:
                    break
            q = pi / 0.5 * p / (pi / 0.5 * p + (1 - pi) / 0.5 * (1 - p))
            now = moved(*soft(xt, q))
        want["balanced_em"] = now
        for name, values in want.items():
            score, prob = run(values)
            r = got[slot["source"], slot["target"], name]
            pos, neg = score[yt == 1], score[yt == 0]
            assert r["auc"] == pytest.approx(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean(), abs=2e-3), name
            assert r["sens"] == pytest.approx((prob[yt == 1] >= 0.5).mean(), abs=0.05) and r["spec"] == pytest.approx((prob[yt == 0] >= 0.5).mean() * -1 + 1, abs=0.05), name
        assert got[slot["source"], slot["target"], "prior_known"]["prior"] == pytest.approx(yt.mean())
        assert got[slot["source"], slot["target"], "balanced_em"]["prior"] == pytest.approx(pi, abs=0.02)


def test_features_are_ranked_only_where_a_setting_takes_the_best(case, monkeypatch):
    _, plan = case
    asked = []
    ranks = S._ranks
    monkeypatch.setattr(S, "_ranks", lambda *a: asked.append(1) or ranks(*a))
    S.lasso_select(plan, 0.2)
    S.site_leak(plan, "combat")
    assert not asked
    sizes = []
    areas = S.vector_areas
    monkeypatch.setattr(S, "vector_areas", lambda cells, *a, **k: sizes.append(cells.selectExpr("max(octet_length(counts)) AS n").first()["n"]) or areas(cells, *a, **k))
    S.prepare(plan, kmax=4)
    assert asked and sizes == [plan.contexts()]  # one byte a context, none for contexts that are not there


def test_areas_of_packed_strips_are_those_of_the_rows(spark, case):
    from evenhand.operators.metrics import site_balanced_auc, weighted_auc

    rows, plan = case
    grid = [{"candidate": 0, "kind": "logreg", "k": 0, "setting": 1.0}, {"candidate": 1, "kind": "logreg", "k": 0, "setting": 1.0, "target": "b|1"}]
    made, shared = S.share(plan, grid, "combat")
    rnd, ctxs = np.random.default_rng(0), [1, 5, 6]
    beta = {(ctx, c): rnd.normal(size=len(made.full[ctx]) + 1) for ctx in ctxs for c in (0, 1)}
    beta[6, 0] *= 0  # all scores are equal
    d = S.scores(plan, shared, beta, grid, [(c, ("test",), [0, 1]) for c in ctxs])
    want = {(r["ctx"], 0): r["sb_auc"] for r in site_balanced_auc(d.where("candidate = 0"), by=["ctx"]).collect()}
    want |= {(r["ctx"], 1): r["auc"] for r in weighted_auc(d.where("candidate = 1").selectExpr("ctx", "score", "int(site = 'b|1') AS y"), by=["ctx"]).collect()}
    for span in (S.SPAN, 9):
        got = {(r["ctx"], r["candidate"]): r["auc"] for r in S.areas_of_tests(plan, made, shared, beta, grid, ctxs, span).collect()}
        assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()} and got[6, 0] == pytest.approx(0.5)


def test_fits_of_many_rows_set_out_from_few_and_end_on_all(spark, monkeypatch):
    n, rnd = 24_000, np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], int(x[0] + x[1] ** 2 + rnd.normal() > 1), [float(v) for v in x]) for i, x in enumerate(rnd.normal(size=(n, 3)))]
    plan = S.pooled_plan(spark.createDataFrame(rows, "key int, site string, y int, features array<double>"), seeds=(1,), k=3, inner=2)
    grid = [{"candidate": 0, "kind": "svm", "k": 3, "setting": 1.0}, {"candidate": 1, "kind": "ridge_all", "k": 0, "setting": 0.01}]
    made, shared = S.share(plan, grid, "none")
    scans, normal = [], S._normal
    monkeypatch.setattr(S, "_normal", lambda *a: scans.append(a[2][0]["setting"]) or normal(*a))
    cold = S.fit_all(plan, made, grid, shared, [0], start={})
    before = len(scans)
    monkeypatch.setattr(S, "FEW", 3000)
    warm = S.fit_all(plan, made, grid, shared, [0])
    after = scans[before:]
    assert set(after) == {1.0, 8.0} and after[-1] == 1.0 and after.count(1.0) < 0.7 * before  # scans of few rows, and of all
    got = {r["key"]: r["v"] for r in plan.rows.select("key", "v").collect()}
    tr = [k for k in range(n) if got[k][0] >= 0]
    site, y = np.array([made.sites[rows[k][1]] for k in tr]), np.array([rows[k][2] for k in tr])
    designs = S.Designs(made, 0, made.z(0, np.array([rows[k][3] for k in tr]), site))
    for c, (g, near) in enumerate(zip(grid, (2e-5, 1e-9))):
        value = [g["setting"] * S._terms(g["kind"], designs.of(g["kind"], g["k"]) @ b[0, c], y, made.weight[0, site, y])[0].sum() + 0.5 * b[0, c][:-1] @ b[0, c][:-1] for b in (cold, warm)]
        assert value[1] <= value[0] * (1 + near)
