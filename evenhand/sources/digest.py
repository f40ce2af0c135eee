"""SHA-256 of files in pieces: a digest whose state is a value, so that another task can go on with it."""

from __future__ import annotations

import _hashlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# hashlib's own library keeps the state of a digest in a plain structure (SHA256_CTX, 112 bytes); hashlib does not hand it out.
LIBRARY = ctypes.CDLL(_hashlib.__file__)
RESUMABLE = all(hasattr(LIBRARY, f"SHA256_{f}") for f in ("Init", "Update", "Final"))
CONTEXT = 112
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd|lzo|xz|passthrough)$"  # names by which Spark's text reader unpacks
MARK = b"\xef\xbb\xbf"  # the text reader leaves it out at the start of a file
CHUNK = "id long, start long, seq long, size long, body binary"


class Sha256:
    def __init__(self, state: bytes | None = None):
        self.own = ctypes.create_string_buffer(state, CONTEXT) if state else ctypes.create_string_buffer(CONTEXT)
        if state is None:
            LIBRARY.SHA256_Init(self.own)

    def update(self, body: bytes) -> None:
        LIBRARY.SHA256_Update(self.own, ctypes.c_char_p(body), ctypes.c_size_t(len(body)))

    def state(self) -> bytes:
        return self.own.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        LIBRARY.SHA256_Final(out, ctypes.create_string_buffer(self.own.raw, CONTEXT))
        return out.raw.hex()


def chunks(lines: DataFrame) -> DataFrame:
    """(id, start, seq, size, body): the lines of each split of a file in their order, each with a line feed after it, joined by batch."""

    def run(batches):
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, starts = (batch.column(c).to_numpy() for c in ("id", "start"))
            edge = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1])) + 1, batch.num_rows]
            line = batch.column("line").cast(pa.large_binary())
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                body = pc.binary_join(pa.LargeListArray.from_arrays([0, b - a], line.slice(a, b - a)), pa.scalar(b"\n", pa.large_binary()))[0].as_py() + b"\n"
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(ids[a]), int(starts[a]), seq, len(body), body)], names=["id", "start", "seq", "size", "body"])
                seq += 1

    return lines.mapInArrow(run, CHUNK)


def advance(state: DataFrame, chunks: DataFrame) -> DataFrame:
    """The states (id, state, done, total, bytes, last) after these chunks, with the digest of what is complete.

    total are the bytes of all chunks, bytes those of the file: they differ by the line feed after a last line that has none, and by a
    byte order mark.
    """

    def run(batches):
        own = None

        def closed():
            key, sha, done, total, size, last = own
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, sha.state(), done, total, size, last, sha.hexdigest() if done == (total or 0) else None), (
                pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["id", "state", "done", "total", "bytes", "last", "sha256"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["seq"] is None:  # the state comes before the chunks
                    if own:
                        yield closed()
                    own = [row["id"], Sha256(row["body"]), row["done"], row["total"], row["bytes"], row["last"]]
                    more = row["bytes"] - (row["total"] or 0)
                    if more not in (-1, 0, 2, 3):
                        raise ValueError(f"a file of {row['bytes']} bytes was read as {row['total']}")
                    if row["body"] is None and more > 0:
                        own[1].update(MARK)
                    continue
                own[2] += row["size"]
                bare = own[2] == own[3] and own[4] - own[3] in (-1, 2)
                own[1].update(row["body"][:-1] if bare else row["body"])
        if own:
            yield closed()

    none = F.lit(None)
    both = state.select("id", none.cast("long").alias("start"), none.cast("long").alias("seq"), none.cast("long").alias("size"), F.col("state").alias("body"), "done", "total", "bytes", "last")
    both = both.unionAll(chunks.select("id", "start", "seq", "size", "body", *[none.cast("long").alias(c) for c in ("done", "total", "bytes")], none.cast("int").alias("last")))
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "id").sortWithinPartitions("id", F.col("start").asc_nulls_first(), "seq")
    return dealt.mapInArrow(run, "id long, state binary, done long, total long, bytes long, last int, sha256 string")
