"""ROC and PR areas of the same scored rows under many weightings at once.

A row carries its weight under every weighting as one vector: how often each bootstrap replicate draws it, or whether a fold's training
part holds it. Rows are sorted once, by range partitioning; every range is walked once in order, with vector sums in place of one
ranking per weighting, and leaves one short row. Vectors are cut into chunks of WIDTH entries, so a task holds no
more than a batch of rows times WIDTH numbers; where fewer weightings are asked for, vectors are only as long as these. Equal scores are folded within batches before they move, so a value that
holds a large part of the rows arrives as a few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.operators.core import row_numbers
from evenhand.session import cut_lineage

WIDTH = 250  # weightings in one vector
STRIP = 1_024  # rows whose vectors are spread out as numbers at a time
BLOCK = 65_536  # rows of a stratum that one task draws among
MASK = np.uint64(0xFFFFFFFF)
# Fixed values of the draw: the step between draws and the multiplier of the 32-bit scramble.
STEP, MULTIPLIER = np.uint64(2654435769), np.uint64(73244475)


def pack(m: np.ndarray) -> pa.Array:
    """Rows of small counts as binary: one byte each where all fit, else two."""
    m = m.astype(np.uint8 if not m.size or m.max() < 256 else np.uint16)
    step = m.shape[1] * m.itemsize
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * step).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(m))])


def unpack(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """The matrix of a packed column whose rows may differ in the size of a count."""
    rows = column.to_pylist()
    out = np.empty((len(rows), width), kind)
    wide = np.array([len(r) > width for r in rows], bool)
    for flag, held in ((False, np.uint8), (True, np.uint16)):
        at = np.flatnonzero(wide == flag)
        if len(at):
            out[at] = np.frombuffer(b"".join([rows[i] for i in at]), held).reshape(len(at), width)
    return out


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, held in 64 bits."""
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * MULTIPLIER) & MASK
    return x ^ (x >> np.uint64(16))


def start_of(seed: int, b: int, stratum: str, block) -> np.uint64:
    return np.uint64(int(hashlib.md5(f"{seed}|{b}|{stratum}|{block}".encode()).hexdigest()[:8], 16))


def numbers(start: np.uint64, first: int, n: int) -> np.ndarray:
    """Draws first + 1 .. first + n of a sequence, below 2**32."""
    return scramble((start + np.arange(first + 1, first + n + 1, dtype=np.uint64) * STEP) & MASK)


def replicate_counts(df: DataFrame, strata: Sequence[str], key: str, b: int, seed: int) -> DataFrame:
    """Rows with ``chunk`` and ``counts``: how often the replicates chunk * WIDTH + 1 .. draw them, as many draws as a stratum has rows.

    Rows are numbered within their stratum and cut into blocks. A stratum of several blocks first spreads each replicate's draws over
    them; a task then deals the draws of a block among its rows. No draw ever leaves its task.
    """
    # the columns of a stratum with their lengths, so that no two strata read alike
    text = F.concat_ws("", *[F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in strata]) \
        if strata else F.lit("")
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("order"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("bigint")
    pos = row_numbers(df.withColumn("_k", order), strata, "_k", [key], out="_j", total="_n").drop("_k")
    pos = cut_lineage(pos.withColumn("_s", text).withColumn("_block", F.floor((F.col("_j") - 1) / BLOCK).cast("int")))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((b - 1) // WIDTH)))
    large = pos.where(F.col("_n") > BLOCK).groupBy("_s").agg(F.first("_n").alias("_n")).withColumn("chunk", chunks)
    share = large.repartition("_s", "chunk").mapInArrow(_shares(b, seed, BLOCK), "_s string, _block int, chunk int, _share binary")
    rows = pos.withColumn("chunk", chunks)
    made = rows.groupBy("_s", "_block", "chunk").cogroup(share.groupBy("_s", "_block", "chunk"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", chunk int, counts binary"
    return made.applyInArrow(_deal(b, seed, df.columns), kinds)


def _shares(b: int, seed: int, block: int):
    """Draws that each replicate of a chunk has in each block of a large stratum."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, blocks = row["_n"], -(-row["_n"] // block)
                out = np.zeros((blocks, WIDTH), np.int64)
                for i in range(min(WIDTH, b - row["chunk"] * WIDTH)):
                    who = row["chunk"] * WIDTH + i + 1
                    high, low = start_of(seed, who, row["_s"], "high"), start_of(seed, who, row["_s"], "low")
                    for at in range(0, n, 1 << 20):
                        k = min(1 << 20, n - at)
                        u = (numbers(high, at, k) * np.uint64(1 << 21) + (numbers(low, at, k) >> np.uint64(11))).astype(np.float64) / 2.0**53
                        out[:, i] += np.bincount((u * n).astype(np.int64) // block, minlength=blocks)
                yield pa.RecordBatch.from_pydict({"_s": [row["_s"]] * blocks, "_block": pa.array(range(blocks), pa.int32()),
                                                  "chunk": pa.array([row["chunk"]] * blocks, pa.int32()), "_share": [x.tobytes() for x in out]})

    return run


def _deal(b: int, seed: int, columns: Sequence[str]):
    """The draws of a block dealt among its rows."""

    def run(group: pa.Table, share: pa.Table) -> pa.Table:
        group = group.sort_by("_j")
        size, first = group.num_rows, group.slice(0, 1).to_pylist()[0]
        given = np.frombuffer(share.column("_share")[0].as_py(), np.int64) if share.num_rows else None
        counts = np.zeros((size, WIDTH), np.uint16)  # two bytes hold a count: a block has at most 2**16 rows and few draws of each
        for i in range(min(WIDTH, b - first["chunk"] * WIDTH)):
            start = start_of(seed, first["chunk"] * WIDTH + i + 1, first["_s"], first["_block"])
            drawn = numbers(start, 0, size if given is None else int(given[i]))
            counts[:, i] = np.bincount(((drawn * np.uint64(size)) >> np.uint64(32)).astype(np.int64), minlength=size)
        return group.select([*columns, "chunk"]).append_column("counts", pack(counts))

    return run


# ---- areas --------------------------------------------------------------------------------------------------
def _fold(by: Sequence[str], size: int):
    """Rows of a batch that agree in all but their counts, summed."""
    keys = [*by, "chunk", "score", "y", "w"]

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            m = unpack(batch.column("counts"), size, np.uint32)
            code = t.select(keys).append_column("_i", pa.array(np.arange(len(m)))).sort_by([(k, "ascending") for k in keys])
            order = code.column("_i").to_numpy()
            new = np.zeros(len(order), bool)
            new[:1] = True
            for k in keys:
                c = code.column(k).combine_chunks()
                ids = c.dictionary_encode(null_encoding="encode")
                ids = np.concatenate([x.indices.to_numpy() for x in ids.chunks]) if isinstance(ids, pa.ChunkedArray) else ids.indices.to_numpy()
                new[1:] |= ids[1:] != ids[:-1]
            at = np.flatnonzero(new)
            if len(at) < len(order):
                folded = np.add.reduceat(m[order], at, axis=0)  # of one batch, so two bytes hold a count
                batch = code.select(keys).take(pa.array(at)).append_column("counts", pack(folded)).combine_chunks().to_batches()[0]
            yield batch.select([*keys, "counts"])

    return run


class _Walk:
    """Sums along the sorted cells of one (by, chunk) within one range; a cell may go on in the next batch."""

    def __init__(self, size: int, below: np.ndarray | None = None):
        self.below = below  # class sums under the range and of all rows, where PR areas are wanted
        self.total = np.zeros((2, size))
        self.area, self.ap = np.zeros(size), np.zeros(size)
        self.open: tuple[float, np.ndarray] | None = None
        self.first: float | None = None

    def add(self, score: np.ndarray, y: np.ndarray, m: np.ndarray) -> None:
        if self.open is not None:
            held, sums = self.open
            score, y, m = np.r_[held, held, score], np.r_[1, 0, y], np.concatenate([sums, m])
        if self.first is None:
            self.first = float(score[0])
        at = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        cells = np.stack([np.add.reduceat(np.where((y == c)[:, None], m, 0.0), at, axis=0) for c in (1, 0)])
        self.open = (float(score[at[-1]]), cells[:, -1])
        self.close(cells[:, :-1])

    def close(self, cells: np.ndarray) -> None:
        if not cells.shape[1]:
            return
        upto = np.cumsum(cells, axis=1) + self.total[:, None]
        self.area += (cells[0] * (upto[1] - cells[1] / 2)).sum(axis=0)
        if self.below is not None:
            over = self.below[2:, None] - self.below[:2, None] - upto + cells
            with np.errstate(all="ignore"):
                self.ap += np.where(cells[0] > 0, cells[0] / self.below[2] * over[0] / (over[0] + over[1]), 0.0).sum(axis=0)
        self.total = upto[:, -1]

    def end(self) -> None:
        if self.open is not None:
            self.close(self.open[1][:, None])
            self.open = None


def _walk(by: Sequence[str], offsets: bool, size: int):
    """One row per (by, chunk) of a sorted range: its first score, class sums, area within, and with ``offsets`` its PR part."""
    keys = [*by, "chunk"]

    def run(batches):
        now, walk, kinds = None, None, None

        def row():
            walk.end()
            vectors = np.concatenate([walk.total, walk.area[None], walk.ap[None]])
            made = {k: pa.array([v], t) for (k, t), v in zip(kinds, now)} | {"first": [walk.first], "sums": [vectors.tobytes()]}
            return pa.RecordBatch.from_pydict(made)

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [(k, batch.schema.field(k).type) for k in keys]
            names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for s, e in zip(edges, edges[1:]):
                part, below = batch.slice(s, e - s), None
                if offsets and part.column("below")[0].is_valid:
                    below, part = np.frombuffer(part.column("below")[0].as_py()).reshape(4, size), part.slice(1)
                if names[s] != now or below is not None:
                    if walk is not None:
                        yield row()
                    now, walk = names[s], _Walk(size, below)
                for at in range(0, part.num_rows, STRIP):
                    strip = part.slice(at, STRIP)
                    weight = strip.column("w").to_numpy(zero_copy_only=False)
                    walk.add(strip.column("score").to_numpy(), strip.column("y").to_numpy(), unpack(strip.column("counts"), size) * weight[:, None])
        if walk is not None:
            yield row()

    return run


def _ranges(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(r).reshape(4, -1) for r in rows])


def _combine(by: Sequence[str], width: int, size: int):
    """Areas of all weightings of a chunk from its ranges."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("first")
        m = _ranges(group.column("sums").to_pylist())
        one, zero, area, ap = m[:, 0], m[:, 1], m[:, 2], m[:, 3]
        below = np.cumsum(zero, axis=0) - zero
        chunk = group.column("chunk")[0].as_py()
        k = min(size, width - chunk * size)
        with np.errstate(all="ignore"):
            auc = ((area + one * below).sum(axis=0) / (one.sum(axis=0) * zero.sum(axis=0)))[:k]
            pr = np.where(one.sum(axis=0) > 0, ap.sum(axis=0), np.nan)[:k]
        head = {c: pa.array([group.column(c)[0].as_py()] * k, group.schema.field(c).type) for c in by}
        return pa.table(head | {"b": pa.array(chunk * size + 1 + np.arange(k), pa.int32()), "auc": pa.array(auc, mask=~np.isfinite(auc)),
                                "pr_auc": pa.array(pr, mask=np.isnan(pr))})

    return run


def _offsets(by: Sequence[str]):
    """What lies below each range, and the totals, as a row that sorts before the range's own."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("first")
        m = _ranges(group.column("sums").to_pylist())[:, :2]
        below, total = np.cumsum(m, axis=0) - m, m.sum(axis=0)
        return group.select([*by, "chunk", "_range"]).append_column("below", pa.array([np.concatenate([x, total]).tobytes() for x in below], pa.binary()))

    return run


def vector_areas(cells: DataFrame, by: Sequence[str], width: int, pr: bool = False, size: int = WIDTH) -> DataFrame:
    """(by, b, auc, pr_auc) of the weightings b = 1 .. ``width``; NULL where a weighting holds one class only.

    ``cells`` has by, chunk, score, y (0 or 1), w (a factor of all the row's weights) and counts, vectors of ``size`` entries. Rows without score or label take
    no part. pr_auc is NULL unless asked for: it needs what lies above a range before the range is walked, so the ranges are written and read twice.
    """
    keys = [*by, "chunk"]
    cells = cells.where(F.col("score").isNotNull() & F.col("y").isNotNull())
    cells = cells.select(*keys, F.col("score").cast("double").alias("score"), F.col("y").cast("int").alias("y"), F.col("w").cast("double").alias("w"), "counts")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    ranged = cells.mapInArrow(_fold(by, size), kinds).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], "score")
    head = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    sort = [F.col(k).asc_nulls_first() for k in keys]
    if not pr:
        parts = ranged.sortWithinPartitions(*sort, "score").mapInArrow(_walk(by, False, size), f"{head}, first double, sums binary")
    else:
        ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
        within = ranged.repartition("_range", *keys).sortWithinPartitions("_range", *sort, "score")
        # the range is one of the keys of a walk, as a task may read several
        sums = within.mapInArrow(_walk(["_range", *by], False, size), f"_range int, {head}, first double, sums binary")
        below = sums.groupBy(*keys).applyInArrow(_offsets(by), f"{head}, _range int, below binary")
        both = ranged.withColumn("below", F.lit(None).cast("binary")).unionByName(below, allowMissingColumns=True)
        both = both.repartition("_range", *keys).sortWithinPartitions("_range", *sort, F.col("below").isNull(), "score")
        parts = both.mapInArrow(_walk(["_range", *by], True, size), f"_range int, {head}, first double, sums binary").drop("_range")
    out = parts.groupBy(*keys).applyInArrow(_combine(by, width, size), ", ".join([f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in by] + ["b int, auc double, pr_auc double"]))
    return out if pr else out.withColumn("pr_auc", F.lit(None).cast("double"))
