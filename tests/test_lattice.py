"""Lattice blocks against brute force; cells move before they name their blocks."""

import numpy as np

from evenhand.operators import grid


def test_blocks_across_stretches_of_the_last_axis(spark):
    rnd = np.random.default_rng(4)
    at = {(int(c), int(z), int(y), int(x)) for c, z, y, x in zip(rnd.integers(0, 2, 400), rnd.integers(0, 6, 400), rnd.integers(0, 12, 400), 240 + rnd.integers(0, 40, 400))}
    at |= {(c, 7, 15, 600) for c in (0, 1)}
    rows = [(*a, bool(rnd.random() < 0.7)) for a in sorted(at)]
    size, stride = (4, 8, 8), (2, 4, 4)
    df = spark.createDataFrame(rows, "case long, z int, y int, x int, mask boolean")
    made = grid.lattice_blocks(df, size, stride, 3)
    got = {(r["case"], r["z"], r["y"], r["x"]): r["n_mask"] for r in made.collect()}
    want = {}
    for c in (0, 1):
        mask = np.array([r[1:4] for r in rows if r[0] == c and r[4]])
        dim = np.array([r[1:4] for r in rows if r[0] == c]).max(0) + 1
        axes = [range(lo // s * s, min(hi, d - n) + 1, s) for lo, hi, d, n, s in zip(mask.min(0), mask.max(0), dim, size, stride)]
        for z in axes[0]:
            for y in axes[1]:
                for x in axes[2]:
                    n = int(((mask >= (z, y, x)) & (mask < (z + 4, y + 8, x + 8))).all(1).sum())
                    if n:
                        want[c, z, y, x] = n
    assert got == want and any(x < 256 <= x + 7 for *_, x in want)
    moves = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert moves and not any("s_x" in line for line in moves)
