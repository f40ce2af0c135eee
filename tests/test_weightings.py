"""Replicate counts and areas under many weightings against plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evenhand.operators import resample, weightings


def number(text, i):
    x = (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + i * 2654435769) % 2**32
    for _ in range(2):
        x = (x ^ x >> 16) * 73244475 % 2**32
    return x ^ x >> 16


def plain_counts(rows, strata, b, seed, block):
    """(key, replicate) -> draws, by naming every draw."""
    groups, out = defaultdict(list), Counter()
    for r in rows:
        groups["".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in strata)].append(r["key"])
    for s, keys in groups.items():
        keys.sort(key=lambda k: (int(hashlib.md5(f"order|{k}".encode()).hexdigest()[:15], 16), k))
        n = len(keys)
        for rep in range(1, b + 1):
            share = Counter({0: n})
            if n > block:
                share = Counter(int((number(f"{seed}|{rep}|{s}|high", i) * 2**21 + (number(f"{seed}|{rep}|{s}|low", i) >> 11)) / 2.0**53 * n) // block for i in range(1, n + 1))
            for blk, c in share.items():
                size = min(block, n - blk * block)
                for i in range(1, c + 1):
                    out[keys[blk * block + (number(f"{seed}|{rep}|{s}|{blk}", i) * size >> 32)], rep] += 1
    return out


def plain_areas(rows, weight):
    pos = [(r["score"], weight(r)) for r in rows if r["y"] == 1 and r["score"] is not None and weight(r)]
    neg = [(r["score"], weight(r)) for r in rows if r["y"] == 0 and r["score"] is not None and weight(r)]
    p, n = sum(w for _, w in pos), sum(w for _, w in neg)
    auc = sum(a * b * ((s > t) + 0.5 * (s == t)) for s, a in pos for t, b in neg) / (p * n) if p and n else None
    ap = sum(a / p * sum(w for t, w in pos if t >= s) / sum(w for t, w in pos + neg if t >= s) for s, a in pos) if p else None
    return auc, ap


@pytest.mark.parametrize("block", [65_536, 7])
def test_counts_and_areas_against_named_draws(spark, monkeypatch, both_paths, block):
    monkeypatch.setattr(weightings, "BLOCK", block)
    rnd = np.random.default_rng(3)
    rows = [{"key": i, "site": [None, "a", "a|1", ""][i % 4], "y": int(rnd.random() < 0.4), "score": None if i % 23 == 0 else float(rnd.integers(0, 9)), "extra": "x"} for i in range(150)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "key int, site string, y int, score double, extra string")
    b = 4
    counts = weightings.replicate_counts(df, ["site", "y"], "key", b, 5)
    got = {}
    for r in counts.collect():
        m = weightings.unpack(weightings.pa.array([r["counts"]]), weightings.WIDTH)[0]
        got |= {(r["key"], i + 1): int(v) for i, v in enumerate(m) if v}
    want = plain_counts(rows, ["site", "y"], b, 5, block)
    assert got == dict(want) and sum(want.values()) == b * len(rows)
    areas = {r["b"]: (r["auc"], r["pr_auc"]) for r in weightings.vector_areas(counts.selectExpr("*", "1.0D AS w"), [], b, pr=True).collect()}
    fast = {r["b"]: r["auc"] for r in weightings.vector_areas(counts.selectExpr("*", "1.0D AS w"), [], b).collect()}
    for rep in range(1, b + 1):
        auc, ap = plain_areas(rows, lambda r: want[r["key"], rep])
        assert areas[rep] == pytest.approx((auc, ap)) and fast[rep] == pytest.approx(auc)


def test_areas_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(i, 1, float(i)) for i in range(5)], "key int, y int, score double")
    counts = weightings.replicate_counts(df, ["y"], "key", 3, 1).selectExpr("*", "1.0D AS w")
    assert [(r["auc"], r["pr_auc"]) for r in weightings.vector_areas(counts, [], 3, pr=True).collect()] == [(None, 1.0)] * 3
    assert weightings.vector_areas(counts.where("key > 9"), [], 3).count() == 0


def test_intervals_need_no_row_per_draw(spark):
    df = spark.createDataFrame([(i, i % 2, ["p", "q"][i // 2 % 2], float(i % 5)) for i in range(400)], "key int, y int, site string, score double")
    plan = resample.stratified_bootstrap(df, b=600)
    assert plan.count() == 600
    counts = weightings.replicate_counts(df, ["site", "y"], "key", 600, 1)
    assert counts.count() == 400 * 3  # a row per chunk of replicates, not per draw


def test_many_chunks_agree_with_few(spark, monkeypatch):
    df = spark.createDataFrame([(i, i * 7 % 3 % 2, float(i * 31 % 17)) for i in range(60)], "key int, y int, score double")
    first = {r["b"]: r["auc"] for r in weightings.vector_areas(weightings.replicate_counts(df, ["y"], "key", 260, 1).selectExpr("*", "2.0D AS w"), [], 260).collect()}
    few = {r["b"]: r["auc"] for r in weightings.vector_areas(weightings.replicate_counts(df, ["y"], "key", 3, 1).selectExpr("*", "1.0D AS w"), [], 3).collect()}
    assert len(first) == 260 and all(first[b] == pytest.approx(few[b]) for b in few)


def test_a_block_is_dealt_in_two_bytes_a_count():
    import tracemalloc

    import pyarrow as pa

    from evenhand.operators import weightings as V

    n = V.BLOCK
    group = pa.table({"key": pa.array(range(n)), "_j": pa.array(range(1, n + 1)), "_s": ["s"] * n, "_block": pa.array([0] * n, pa.int32()), "chunk": pa.array([0] * n, pa.int32())})
    tracemalloc.start()
    made = V._deal(V.WIDTH, 1, ["key"])(group, group.slice(0, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = V.unpack(made.column("counts"), V.WIDTH)
    assert (counts.sum(axis=0) == n).all() and peak < 3 * n * V.WIDTH * 2
