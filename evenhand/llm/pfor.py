"""Operator 6: token ids in files of patched frame-of-reference blocks.

Rows are dealt by ranges of (document id, hash of the text, row), so rows of one id, or of none, are spread like any others. A task
writes its range as consecutive shard files and closes one as soon as it has SHARD_ROWS documents or SHARD_IDS ids:

    magic, four 64-bit numbers (documents, ids, length of the document part, length of the id part)
    document part: the document ids, their numbers of tokens (64-bit each), and a byte each that is 1 for a null id
    id part: block starts (64-bit, one more than there are blocks), then the blocks

A block has up to 256 ids: the minimum (32 bit), the width and the number of exceptions (16 bit each), the low bits of
(id - minimum), then the places (8 bit) and the high bits (32 bit) of the exceptions. The width is the one that holds the
given percentile of the block's values; what does not fit is an exception. The last block is filled up with its minimum.

Every shard is written under a name of its own attempt and then renamed, so a task that runs twice leaves one file.
Null and empty texts have the end id alone. Repeated document ids stay separate documents, null ids come first and stay null.
"""

from __future__ import annotations

import bisect
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.bpe import encoder
from evenhand.llm.common import slices
from evenhand.session import cut_lineage, scratch_path

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENTILE = 90
SHARD_ROWS, SHARD_IDS = 4096, 1 << 22
SAMPLED = 200  # rows for each cut between ranges


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Byte offset of every block (and the end), and the blocks."""
    n = len(ids)
    if n == 0:
        return np.zeros(1, np.int64), b""
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.int64)
    full[:n] = ids
    full[n:] = ids[(blocks - 1) * BLOCK: n].min()
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    bits = bit_lengths(rest)
    width = np.partition(bits, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]
    high = rest >> width[:, None]
    odd = high > 0
    exceptions = odd.sum(axis=1)
    sizes = 8 + width * (BLOCK // 8) + exceptions * 5
    starts = np.r_[0, np.cumsum(sizes)]
    out = np.zeros(starts[-1], np.uint8)
    head = np.empty((blocks, 8), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(blocks, 4)
    head[:, 4:6] = width.astype("<u2").view(np.uint8).reshape(blocks, 2)
    head[:, 6:] = exceptions.astype("<u2").view(np.uint8).reshape(blocks, 2)
    out[starts[:-1, None] + np.arange(8)] = head
    for w in np.unique(width):
        if w == 0:
            continue
        own = np.flatnonzero(width == w)
        plane = ((rest[own][:, :, None] >> np.arange(w)) & 1).astype(np.uint8)
        packed = np.packbits(plane.reshape(len(own), -1), axis=1, bitorder="little")
        out[starts[own][:, None] + 8 + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(odd)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        tail = starts[row] + 8 + width[row] * (BLOCK // 8)
        out[tail + nth] = place
        far = tail + exceptions[row] + 4 * nth
        out[far[:, None] + np.arange(4)] = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts, out.tobytes()


def unpack(body: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of consecutive blocks; ``starts`` are their byte offsets in ``body``."""
    blocks = len(starts) - 1
    if blocks <= 0:
        return np.zeros(0, np.int64)
    head = body[starts[:-1, None] + np.arange(8)]
    least = head[:, :4].copy().view("<u4").reshape(-1).astype(np.int64)
    width = head[:, 4:6].copy().view("<u2").reshape(-1).astype(np.int64)
    exceptions = head[:, 6:].copy().view("<u2").reshape(-1).astype(np.int64)
    out = np.zeros((blocks, BLOCK), np.int64)
    for w in np.unique(width):
        if w == 0:
            continue
        own = np.flatnonzero(width == w)
        packed = body[starts[own][:, None] + 8 + np.arange(w * (BLOCK // 8))]
        plane = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, w)
        out[own] = plane @ (1 << np.arange(w, dtype=np.int64))
    row = np.repeat(np.arange(blocks), exceptions)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        tail = starts[row] + 8 + width[row] * (BLOCK // 8)
        far = tail + exceptions[row] + 4 * nth
        high = body[far[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.int64)
        np.add.at(out, (row, body[tail + nth]), high << width[row])
    return (out + least[:, None]).reshape(-1)[:n]


def folder_of(uri: str):
    """File system and path of a folder that all executors share."""
    return pafs.FileSystem.from_uri(uri)


def shard_name(path: str, part: int, number: int) -> str:
    return f"{path}/shard-{part:05d}-{number:07d}.pfor"


def write_shard(root: str, part: int, number: int, keys: list, counts: np.ndarray, ids: np.ndarray) -> str:
    fs, path = folder_of(root)
    starts, blocks = pack(ids)
    null = np.array([k is None for k in keys], np.uint8)
    docs = np.stack([np.array([k or 0 for k in keys], np.int64), counts]).astype("<i8").tobytes() + null.tobytes()
    body = starts.astype("<i8").tobytes() + blocks
    name, draft = shard_name(path, part, number), f"{path}/.{part}-{number}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(MAGIC + np.array([len(keys), len(ids), len(docs), len(body)], "<i8").tobytes() + docs + body)
    fs.move(draft, name)
    return name


def read_shard(root: str, part: int, number: int, blocks_at_once: int = 4096):
    """Keys (an array with nulls) and counts of a shard, and its ids in consecutive pieces."""
    fs, path = folder_of(root)
    f = fs.open_input_file(shard_name(path, part, number))
    head = f.read(40)
    if head[:8] != MAGIC:
        raise ValueError(f"not a shard: {path}")
    n_docs, n_ids, docs, _ = np.frombuffer(head[8:], "<i8")
    raw = f.read(docs)
    keys, counts = np.frombuffer(raw[: 16 * n_docs], "<i8").reshape(2, n_docs)
    keys = pa.array(keys, mask=np.frombuffer(raw[16 * n_docs:], np.uint8) > 0)
    base = 40 + docs
    n_blocks = -(-n_ids // BLOCK)
    f.seek(base)
    starts = np.frombuffer(f.read(8 * (n_blocks + 1)), "<i8")
    base += 8 * (n_blocks + 1)

    def pieces():
        for b in range(0, n_blocks, blocks_at_once):
            e = min(n_blocks, b + blocks_at_once)
            f.seek(base + starts[b])
            body = np.frombuffer(f.read(starts[e] - starts[b]), np.uint8)
            yield unpack(body, starts[b: e + 1] - starts[b], min(n_ids, e * BLOCK) - b * BLOCK)

    return keys, counts, pieces()


def order_of(key, h: int, row: int) -> tuple:
    return key is not None, key or 0, h, row


def cuts_of(src: DataFrame, parts: int) -> list[tuple]:
    """The places (order) at which the rows are cut into ranges, from about SAMPLED rows a range whatever the number of rows."""
    n = src.count()
    if parts < 2 or not n:
        return []
    step = max(1, n // (SAMPLED * parts))
    rows = src.where(F.pmod(F.xxhash64("_row"), F.lit(step)) == 0).select("_key", "_h", "_row").collect()
    line = sorted(order_of(*r) for r in rows)
    return sorted({line[len(line) * i // parts] for i in range(1, parts)}) if line else []


def write_tokens(df: DataFrame, path: str, root: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes shards in ascending order of the integer ``key`` under ``root``.

    Returns one row per shard: part, number, n_docs, n_ids and start (ids of all documents before it). Text is encoded once and its ids are
    moved once; a task holds one shard. Only the cuts between ranges, one per shuffle partition, pass the driver.
    """
    spark = df.sparkSession
    raw = spark.sparkContext.broadcast(open(path, "rb").read())
    src = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    src = src.withColumn("_h", F.xxhash64("_text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(cuts_of(src, parts))
    folder_of(root)[0].create_dir(folder_of(root)[1], recursive=True)
    most_rows, most_ids = SHARD_ROWS, SHARD_IDS

    def encode(batches):
        enc = encoder(raw.value)
        small = "<u2" if max(enc.names) < 1 << 16 and end_id < 1 << 16 else "<u4"
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, counts = enc.ids(part.column("_text"))
                ends = np.cumsum(counts)
                with_end = np.insert(flat, ends, end_id).astype(small)
                stops = (ends + np.arange(1, len(ends) + 1)) * with_end.itemsize
                own = [part.column(c) for c in ("_key", "_h", "_row")]
                place = [bisect.bisect_right(cuts.value, order_of(*r)) for r in zip(*(c.to_pylist() for c in own))]
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(np.r_[0, stops].astype(np.int32)), pa.py_buffer(with_end)])
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *own, pa.array(counts + 1), blob], names=["part", "_key", "_h", "_row", "n", "ids"])

    def write(batches):
        part, number, before, keys, counts, blobs, size = None, 0, 0, [], [], [], 0

        def store():
            ids = np.concatenate([np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4") for b, n in zip(blobs, counts)])
            write_shard(root, part, number, keys, np.array(counts), ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": [len(keys)], "n_ids": [len(ids)], "before": [before]})

        for batch in batches:
            for p, k, n, b in zip(*(batch.column(c).to_pylist() for c in ("part", "_key", "n", "ids"))):
                if keys and (p != part or len(keys) >= most_rows or size + n > most_ids):
                    yield store()
                    number, before = number + 1, before + size
                    keys, counts, blobs, size = [], [], [], 0
                if p != part:
                    part, number, before = p, 0, 0
                keys.append(k)
                counts.append(n)
                blobs.append(b)
                size += n
        if keys:
            yield store()

    encoded = src.mapInArrow(encode, "part int, _key long, _h long, _row long, n long, ids binary")
    dealt = encoded.repartition(parts, "part").sortWithinPartitions("part", F.col("_key").asc_nulls_first(), "_h", "_row")
    shards = cut_lineage(dealt.mapInArrow(write, "part int, number int, n_docs long, n_ids long, before long"))
    # one row per range
    upto = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    ranges = shards.groupBy(F.col("part").alias("_p")).agg(F.sum("n_ids").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    return shards.join(ranges, F.col("part") == F.col("_p")).select("part", "number", "n_docs", "n_ids", (F.col("_start") + F.col("before")).alias("start"))


def read_tokens(shards: DataFrame, root: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document of the shards, from the files."""

    def run(batches):
        for batch in batches:
            for part, number, start in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "start"))):
                keys, counts, pieces = read_shard(root, part, number)
                sums, doc, left, crc = [], 0, int(counts[0]) if len(counts) else 0, 0
                for ids in pieces:
                    raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                    while at < len(ids):
                        take = min(left, len(ids) - at)
                        crc = zlib.crc32(raw[4 * at: 4 * (at + take)], crc)
                        at, left = at + take, left - take
                        if left == 0:
                            sums.append(crc)
                            doc, crc = doc + 1, 0
                            left = int(counts[doc]) if doc < len(counts) else 0
                starts = start + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())],
                                                 names=["_key", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "number", "start").mapInArrow(run, "_key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("_key", key)


def token_files(df: DataFrame, path: str, root: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards of ``df`` and returns what reading them back gives: key, start, n_tokens, ids_crc32.

    ``root`` is a folder URI that all executors reach; by default a new one below the checkpoint folder. An empty table gives no shard and no row.
    """
    root = root or scratch_path(df.sparkSession, "tokens")
    shards = write_tokens(df, path, root, key, text)
    return read_tokens(shards.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "number"), root, key)
