"""Near copies, repeated lines, repeated strings and near vectors against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evenhand.llm import components, embeddings, jaccard, lines, substrings
from tests.llm.samples import frame, texts

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4))


def similar(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 75 * (len(a) + len(b) - both)


def roots(n, edges):
    part = list(range(n))

    def find(x):
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for a, b in edges:
        part[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_components(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = texts(spark, 200)
    sets = [shingles(t) for _, t in rows]
    part = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b])])
    least = defaultdict(lambda: None)
    for (i, _), p in zip(rows, part):
        if i is not None:
            least[p] = i if least[p] is None else min(i, least[p])
    got = Counter(tuple(r) for r in jaccard.with_components(frame(spark, rows)).collect())
    assert got == Counter((i, len(s), least[p]) for (i, _), s, p in zip(rows, sets, part))
    kept = jaccard.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} >= {9001, 9002, 9007} and 9008 not in {r["doc_id"] for r in kept.collect()}


def test_null_ids_link_and_bridge(spark):
    w = [f"n{i}" for i in range(60)]
    near, far = [*w[:50], *[f"x{i}" for i in range(10)]], [f"y{i}" for i in range(7)] + w[7:]
    both = jaccard.with_components(frame(spark, [(1, " ".join(w[:52])), (None, " ".join(w)), (2, " ".join(w[8:])), (None, "p q r s t u"), (None, "p q r s t u"), (3, " ".join(near)), (4, " ".join(far))]))
    sets = [shingles(" ".join(x)) for x in (w[:52], w, w[8:])]
    assert similar(sets[0], sets[1]) and similar(sets[1], sets[2]) and not similar(sets[0], sets[2])
    got = Counter((r["doc_id"], r["component_id"]) for r in both.collect())
    assert got[1, 1] == 1 and got[2, 1] == 1 and got[None, 1] == 1 and got[None, None] == 2


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("doc_id = 2")
    assert jaccard.with_components(none).count() == 0
    assert lines.line_report(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0


def test_signature_bounds_never_lose_a_link():
    rnd = np.random.default_rng(1)
    base = rnd.integers(1 << 62, size=400).astype(np.uint64)
    sets = [np.unique(np.r_[base[: rnd.integers(250, 400)], rnd.integers(1 << 62, size=rnd.integers(0, 80)).astype(np.uint64)]) for _ in range(60)]
    n, bits = np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets]
    part = np.arange(len(sets))
    root = jaccard.tree(n, bits, part, np.argsort(n, kind="stable"))
    found = {frozenset((int(a), int(b))) for x, y in jaccard.dual(root, root, n, part, 75) for a, b in zip(x, y)}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (n[a] + n[b] - both):
                assert frozenset((a, b)) in found


@pytest.mark.parametrize("heavy", [32, 1])
def test_lines_against_all_pairs(spark, monkeypatch, heavy):
    monkeypatch.setattr(lines, "HEAVY", heavy)
    rows = [r for r in texts(spark, 100) if r[0] is not None]
    items = [((i, k), shingles(x), r, k) for r, (i, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n"))]
    items = [x for x in items if x[1]]
    gone = defaultdict(set)
    for at, s, r, k in items:
        # Rows that repeat id and text share one decision.
        if any(other < at and similar(s, o) for other, o, _, _ in items):
            gone[r].add(k)
    want = Counter()
    for r, (i, t) in enumerate(rows):
        parts = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(parts) if k not in gone[r])
        want[i, 0 if t is None else len(parts), len(gone[r]), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in lines.line_report(frame(spark, rows)).collect()) == want


def test_lines_keep_columns_and_nulls(spark):
    out = lines.drop_repeated_lines(frame(spark, [(1, None), (2, "a b c d e f"), (3, "A b c d e f")]))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: None, 2: "a b c d e f", 3: ""}
    assert out.columns[:-2] == frame(spark, [(1, "x")]).columns


def test_short_lines_go_as_wholes(spark):
    rows = [(1, "All rights reserved.\nMenu\n\na b c d"), (2, "menu\nall RIGHTS  reserved.\n\na b c\nb a c d"), (None, "a b c"), (3, None)]
    out = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(frame(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "\nb a c d", None: "a b c", 3: None}


def test_lines_beyond_two_to_the_19(spark):
    many = (1 << 19) + 3
    long = "\n".join(["a b c d e f", *[""] * (many - 3), "p q r s t u", "a b c d e f"])
    out = lines.line_report(frame(spark, [(1, long), (2, "p q r s t u\nv w x y z 1")])).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in out} == {
        1: (many, 1, hashlib.sha256(long[: long.rindex("\n")].encode()).hexdigest()), 2: (2, 1, hashlib.sha256(b"v w x y z 1").hexdigest())}
    body, off = np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)])
    assert np.unique(lines.line_sets(body, off)[0]).tolist() == [0, many - 2, many - 1]


@pytest.mark.parametrize("most", [50_000, 1])
def test_repeated_strings(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST", most)
    rows = texts(spark, 60)
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k: k + 400] for b in bodies for k in range(len(b) - 399))
    want = Counter()
    for (i, _), b in zip(rows, bodies):
        cut = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if seen[b[k: k + 400]] > 1:
                cut[k: k + 400] = True
        kept = bytes(x for x, c in zip(b, cut) if not c)
        want[i, len(b), int(cut.sum()), int((cut[1:] & ~cut[:-1]).sum() + cut[0]), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in substrings.remove_repeats(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("block", [1024, 3])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal((30, 16))
    rows = [(i, base[i].tolist(), int(i % 2)) for i in range(30)]
    rows += [(100 + i, (base[i % 6] + 0.05 * rnd.standard_normal(16)).tolist(), int(i % 2)) for i in range(60)]
    rows += [(200, base[0].tolist(), 0), (201, (3 * base[0]).tolist(), 0), (201, base[0].tolist(), 0), (202, base[0].tolist(), None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0),
             (206, [None] + [1.0] * 15, 0), (207, [], 0), (208, base[0].tolist() + [0.0], 0), (209, [1e300] * 16, 1), (210, [1e-300] * 16, 1)]
    ok = lambda r: r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])
    unit = [None if not ok(r) else (lambda v: v / np.linalg.norm(v))(np.array(r[1]) / np.abs(r[1]).max()) for r in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    links, part, least = Counter(x for e in near for x in e), roots(len(rows), near), {}
    for r, p in zip(rows, part):
        least[p] = min(r[0], least.get(p, r[0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert Counter(tuple(r) for r in embeddings.near_duplicates(df).collect()) == Counter((r[0], links[x], least[part[x]], r[0] == least[part[x]]) for x, r in enumerate(rows))


def test_components_of_chains_loops_and_repeats(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600), (700, 702), (702, 701)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {601: 600, 701: 700, 702: 700}
    assert components.components(df.where("a < 0")).count() == 0


@pytest.mark.parametrize("dense", [8, 0])
def test_a_dense_group(spark, monkeypatch, dense):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    rnd = np.random.default_rng(7)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(60):  # all near the limit, some beyond
        w = list(base)
        for k in rnd.choice(60, size=int(rnd.integers(1, 3)), replace=False):
            w[k] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    part = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b])])
    least = {p: min(i for i, q in enumerate(part) if q == p) for p in part}
    got = {r["doc_id"]: r["component_id"] for r in jaccard.with_components(frame(spark, rows)).collect()}
    assert got == {i: least[p] for i, p in enumerate(part)} and len(set(part)) > 1


def test_only_sets_that_are_compared_are_stored(spark, monkeypatch):
    """Documents that share half of their shingles meet in a group, but their bitmaps tell them apart; near copies are compared."""
    common = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(common + [f"{i}x{j}" for j in range(200)])) for i in range(1, 7)]
    copy = [f"n{j}" for j in range(300)]
    rows += [(11, " ".join(copy)), (12, " ".join([*copy[:150], "changed", *copy[151:]]))]
    held, cut = [], jaccard.cut_lineage
    monkeypatch.setattr(jaccard, "cut_lineage", lambda df: held.append(cut(df)) or held[-1])
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5)  # equal rows in several tasks
    got = {r["doc_id"]: r["component_id"] for r in jaccard.with_components(df).collect()}
    assert got == {i: i for i in range(1, 7)} | {11: 11, 12: 11}
    assert [df.select("cls").distinct().count() for df in held if "shingles" in df.columns] == [2, 0]


def expected_components(rows):
    sets = [shingles(t) for _, t in rows]
    part = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b])])
    return {i: min(j for (j, _), q in zip(rows, part) if q == p) for (i, _), p in zip(rows, part)}


def test_chance_meetings_leave_no_members(spark, monkeypatch):
    # Each two of 12 texts share a passage of their own: a text has 80% of its shingles in others, but a pair shares 7%.
    passage = {(a, b): " ".join(f"p{a}_{b}_{k}" for k in range(20)) for a in range(12) for b in range(a)}
    rows = [(i, " ".join(passage[max(i, j), min(i, j)] for j in range(12) if j != i)) for i in range(12)]
    own = [f"w{k}" for k in range(220)]
    rows += [(20, " ".join(own)), (21, " ".join([*own[:210], *"abcdefghij"]))]
    left, possible = [], jaccard.possible
    monkeypatch.setattr(jaccard, "possible", lambda *a: left.append(possible(*a)) or left[-1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.with_components(frame(spark, rows)).collect()}
    assert got == expected_components(rows) and got[21] == 20
    assert len({r["cls"] for r in left[0].collect()}) == 2


@pytest.mark.parametrize("small", [1, 2, 4])
def test_small_and_wide_groups_lose_no_link(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = np.random.default_rng(5)
    rows = []
    for family in range(12):  # near copies of 2 to 13 members, close to the limit, which also share passages with other families
        base = [f"f{family}_{k}" for k in range(int(rng.integers(12, 120)))] + [f"all{k}" for k in range(9)]
        for _ in range(family + 2):
            words = [w if rng.random() > 0.025 else f"x{rng.integers(1 << 30)}" for w in base]
            rows.append((len(rows), " ".join(words[: len(words) - int(rng.integers(0, 9))])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.with_components(frame(spark, rows)).collect()}
    want = expected_components(rows)
    assert got == want and 12 < len(set(want.values())) < len(rows)
