"""Boosted trees on binned columns, one fit in a task: grown leaf by leaf, on samples of rows and columns, with as many rows as its scratch folder holds.

Gradients are whole numbers, so sums do not depend on the order or the cut of the rows, nor does a tree.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np

BINS = 64
CELLS = 1_024  # of the grid on which quantiles are taken
BLOCK = 1 << 15  # rows worked on at a time
FLAT = 1 << 12  # rows from which two columns share a count
ROOM = 1 << 28  # bytes of a fit kept in memory, the rest lies in a file of the task
SCALE = 2.0**23  # steps of a gradient, as many as 4-byte floats tell apart
ONE = 2.0**37  # a row of the bag, counted in one sum with curvatures: those of a block stay below it


# ---- columns to bins ----------------------------------------------------------------------------------------
def cells(z: np.ndarray) -> np.ndarray:
    """Places of standardised values on a fixed grid, 0.002 wide around 0, wider towards its open ends."""
    u = z / (1.0 + np.abs(z))
    return np.minimum((u + 1.0) * (CELLS / 2), CELLS - 1).astype(np.int64)


def count_cells(z: np.ndarray) -> np.ndarray:
    """Rows per (column, cell)."""
    k = z.shape[1]
    return np.bincount((cells(z) + CELLS * np.arange(k)).ravel(), minlength=k * CELLS).reshape(k, CELLS)


def bins_of_cells(counts: np.ndarray) -> np.ndarray:
    """The bin of every cell of a column: BINS quantiles of all its rows."""
    below = counts.cumsum(axis=1) - counts
    return (below * BINS // np.maximum(counts.sum(axis=1, keepdims=True), 1)).clip(max=BINS - 1).astype(np.uint8)


def to_bins(z: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(column, row) bins of values (row, column)."""
    return np.take_along_axis(table, cells(z).T, axis=1)


# ---- models -------------------------------------------------------------------------------------------------
@dataclass
class Trees:
    """``splits`` (tree, split, [leaf, column, bin]): rows of the leaf above the bin go to a new leaf, numbered by split; leaf -1 ends a tree."""

    base: float
    splits: np.ndarray
    values: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.splits.nbytes + self.values.nbytes

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.base)
        node = np.empty(bins.shape[1], np.uint8)
        for splits, values in zip(self.splits.tolist(), self.values):
            node[:] = 0
            for new, (leaf, column, edge) in enumerate(splits, 1):
                if leaf < 0:
                    break
                _part(node, bins, leaf, column, edge, new)
            out += values[node]
        return out


def _part(node: np.ndarray, bins: np.ndarray, leaf: int, column: int, edge: int, new: int) -> None:
    above = bins[column] > edge
    above &= node == leaf
    node += above.view(np.uint8) * np.uint8(new - leaf)


# ---- rows of a fit ------------------------------------------------------------------------------------------
class Rows:
    """Training rows as blocks of (bins, signed weight, hash): the weight is negative for the class 0."""

    def __init__(self, room: int = ROOM):
        self.blocks: list = []
        self.waiting: list = []
        self.left = room

    def add(self, bins: np.ndarray, signed: np.ndarray, hashes: np.ndarray) -> None:
        self.waiting.append((bins, signed, hashes))
        if sum(len(s) for _, s, _ in self.waiting) >= BLOCK:
            self.close(BLOCK)

    def close(self, least: int = 1) -> None:
        """The rows that wait become blocks of BLOCK rows, a rest of fewer than ``least`` waits on."""
        if self.waiting:
            bins, signed, hashes = (np.concatenate(a, axis=-1) for a in zip(*self.waiting))
            self.waiting = []
            for at in range(0, len(signed), BLOCK):
                part = bins[:, at: at + BLOCK], signed[at: at + BLOCK], hashes[at: at + BLOCK]
                if len(part[1]) >= least:
                    self.blocks.append(_Block(*part, self._keep))
                else:
                    self.waiting.append(part)

    def _keep(self, shape, kind) -> np.ndarray:
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        self.left -= size
        return np.empty(shape, kind) if self.left >= 0 else np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=shape)


class _Block:
    def __init__(self, bins, signed, hashes, keep):
        n = len(signed)
        self.bins, self.signed, self.hashes = keep(bins.shape, np.uint8), keep(n, np.float32), keep(n, np.uint32)
        self.bins[:], self.signed[:], self.hashes[:] = bins, signed, hashes
        self.f, self.node, self.bag, self.g, self.h = keep(n, np.float32), keep(n, np.uint8), keep(n, bool), keep(n, np.float64), keep(n, np.float64)

    def gradients(self, scale: float) -> None:
        """Slope and curvature of the log loss of the rows in the bag, 0 of the others."""
        q = np.sign(self.signed) * self.f
        np.minimum(q, 80.0, out=q)
        np.exp(q, out=q)
        q += 1.0
        np.reciprocal(q, out=q)  # 1 - probability of the row's own class
        slope = q * self.signed
        slope *= -scale
        curve = np.abs(slope) * (1.0 - q)
        np.multiply(np.rint(slope), self.bag, out=self.g)
        self.h[:] = np.rint(curve)
        self.h += ONE
        self.h *= self.bag


def _bag(hashes: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Rows drawn for a tree: by their hash mixed with its number, the same however the rows are dealt."""
    u = hashes ^ np.uint32((tree * 0x9E3779B9 + seed * 0x7FEB352D) & 0xFFFFFFFF)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        u ^= u >> np.uint32(shift)
        u *= np.uint32(by)
    u ^= u >> np.uint32(16)
    return u < np.uint32(min(int(share * 2**32), 2**32 - 1))


def _histogram(bins: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray, rows=None) -> np.ndarray:
    """Sums of (g, h, rows of the bag) per (column, bin), of all rows of a block or of some."""
    k = len(columns)
    if rows is not None:
        g, h = g[rows], h[rows]
    if len(g) < FLAT:
        part = bins[columns] if rows is None else bins[columns[:, None], rows]
        code = (part + np.arange(k)[:, None] * BINS).ravel()
        out = np.stack([np.bincount(code, np.tile(w, k), k * BINS) for w in (g, h)]).reshape(2, k, BINS)
    else:
        out = np.empty((2, k, BINS))
        for i in range(0, k, 2):  # two columns share a count
            code = bins[columns[i]].astype(np.uint16)
            code *= BINS
            if i + 1 < k:
                code += bins[columns[i + 1]]
            code = (code if rows is None else code.take(rows)).astype(np.intp)
            for s, w in enumerate((g, h)):
                sums = np.bincount(code, w, BINS * BINS).reshape(BINS, BINS)
                out[s, i] = sums.sum(axis=1)
                if i + 1 < k:
                    out[s, i + 1] = sums.sum(axis=0)
    n = np.floor(out[1] / ONE)
    return np.stack([out[0], out[1] - n * ONE, n])


def _best(hist: np.ndarray, least: int, least_h: float) -> list:
    """Per leaf (gain, column, bin, sums left, sums right) of its best split, the first of equal ones; gain 0 where no split is allowed."""
    left = hist.cumsum(axis=3)
    total = left[:, :, :1, -1:]
    left = left[:, :, :, :-1]
    right = total - left
    gain = left[:, 0] ** 2 / np.maximum(left[:, 1], 1.0)
    gain += right[:, 0] ** 2 / np.maximum(right[:, 1], 1.0)
    gain[np.minimum(left[:, 2], right[:, 2]) < least] = -1.0
    gain[np.minimum(left[:, 1], right[:, 1]) < least_h] = -1.0
    out = []
    for i, at in enumerate(gain.reshape(len(gain), -1).argmax(axis=1).tolist()):
        column, edge = divmod(at, BINS - 1)
        g, h = total[i, :2, 0, 0].tolist()
        out.append((float(gain[i, column, edge]) - g * g / max(h, 1.0), column, edge, left[i, :, column, edge], right[i, :, column, edge]))
    return out


def grow(rows: Rows, leaves: int, trees: int = 200, rate: float = 0.03, least: int = 10, share: float = 0.8, columns: float = 0.5, seed: int = 1) -> Trees:
    """Trees of up to ``leaves`` leaves, the leaf of the largest gain split first, every leaf with ``least`` rows of the bag; no penalty."""
    rows.close()
    blocks = rows.blocks
    k = blocks[0].bins.shape[0] if blocks else 0
    splits, values = np.full((trees, leaves - 1, 3), -1, np.int16), np.zeros((trees, leaves))
    one, zero = (sum(float(np.maximum(s * b.signed, 0).sum(dtype=np.float64)) for b in blocks) for s in (1, -1))
    if not one or not zero or not k:
        return Trees(np.log(one / zero) if one and zero else 0.0, splits, values)
    base, scale = float(np.float32(np.log(one / zero))), SCALE / max(float(np.abs(b.signed).max()) for b in blocks)
    for b in blocks:
        b.f[:] = base
    rnd = np.random.default_rng(seed)
    for t in range(trees):
        drawn = np.sort(rnd.permutation(k)[: max(1, int(k * columns + 0.5))])
        hist = 0
        for b in blocks:
            b.bag[:] = _bag(b.hashes, t, seed, share)
            b.gradients(scale)
            b.node[:] = 0
            hist = hist + _histogram(b.bins, drawn, b.g, b.h)
        best = {0: (*_best(hist[None], least, 1e-3 * scale), hist)}
        sums = {}
        for new in range(1, leaves):
            leaf = max(best, key=lambda i: (best[i][0][0], -i))
            (gain, column, edge, left, right), hist = best[leaf]
            if gain <= 1e-9 * scale:
                break
            splits[t, new - 1] = leaf, drawn[column], edge
            sums[leaf], sums[new] = left, right
            for b in blocks:
                _part(b.node, b.bins, leaf, drawn[column], edge, new)
            if new < leaves - 1:
                small, other = (leaf, new) if left[2] <= right[2] else (new, leaf)
                part = sum(_histogram(b.bins, drawn, b.g, b.h, np.flatnonzero((b.node == small) & b.bag)) for b in blocks)
                both = np.stack([part, hist - part])
                best[small], best[other] = zip(_best(both, least, 1e-3 * scale), both)
        if sums:
            for i, (g, h, _) in sums.items():
                values[t, i] = -rate * g / h
            step = values[t].astype(np.float32)
            for b in blocks:
                b.f += step[b.node]
    return Trees(base, splits, values)
