"""Operator 5: removal of lines that repeat an earlier line, by an exact set-similarity join.

A line is the set of its five-word shingles; a line of fewer words has one, of all its words. Shingles stand in order of rarity: the most frequent of the corpus (a bounded
list) come last, the others by fingerprint. Two sets at or above the limit share a shingle among the first
n - ceil(t n) + 1 of each. Where two lines meet in such a shingle, the length filter and the positional filter (what is left
after the shingle on either side bounds the overlap) drop most pairs; the others are verified on the whole sets.

A line goes if any earlier line, by document id and place, is equal or similar to it; whether that one goes too makes
no difference. Lines without words stay. Null texts stay null, and a document whose lines all go
becomes an empty text. Rows that repeat id and text share one decision; rows that repeat an id alone are
ordered by a hash of their text. Rows with a null id come first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import Rolling, flat_bytes, mix, slices, spread
from evenhand.llm.jaccard import BLOOM_WORDS, COUNTED, FREQUENT, OFTEN, bloom_of, shingle_values
from evenhand.llm.shingles import LOWER, TURNS, WORDS, spans
from evenhand.session import cut_lineage

LIMIT = 75
TOKEN = 44  # bits of a shingle
LEADING = 22  # of them in the table of frequent shingles
ROOM = 1 << 63 - TOKEN  # lines that are sorted together
PAIRS = 1 << 21  # pairs looked at together
HEAVY = 32  # lines of one shingle that are paired at once; beyond, the earliest comes first
BLOCK = 2048  # lines of one shingle in one task
U = np.uint64


class Late:
    """The shingles that come last. Their leading bits are looked up in a table first, which rules out most of the others."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.leading = tokens, np.zeros(1 << LEADING, bool)
        self.leading[tokens >> U(TOKEN - LEADING)] = True

    def holds(self, token: np.ndarray) -> np.ndarray:
        out = self.leading[token >> U(TOKEN - LEADING)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.tokens, token[some]), len(self.tokens) - 1)
            out[some] = self.tokens[at] == token[some]
        return out


def line_sets(body: np.ndarray, off: np.ndarray, late: Late | None = None):
    """(line, token, late) of all distinct shingles, by line, late ones last; first line of each text and all numbers of words."""
    breaks = np.flatnonzero(body == 10)
    starts = np.sort(np.r_[off[:-1], breaks + 1])  # a line after a last break starts where the next text does, and has no words
    texts = np.arange(len(off) - 1)
    first = texts + np.searchsorted(breaks, off[:-1], "left")
    begin, end = spans(body, off)
    code = Rolling(LOWER[body]).of(begin, end)
    line = np.searchsorted(starts, begin, "right") - 1
    count = np.bincount(line, minlength=len(starts))
    n = max(len(code) - WORDS + 1, 0)
    total = np.zeros(n, U)
    for j in range(WORDS if n else 0):
        total += code[j: j + n] * TURNS[j]
    inside = line[:n] == line[WORDS - 1:] if n else np.zeros(0, bool)
    token, own = mix(total[inside]) >> U(64 - TOKEN), line[:n][inside]
    # a line of fewer words is one shingle of all its words
    few = np.flatnonzero(count[line] < WORDS)
    if len(few):
        place = few - (np.cumsum(count) - count)[line[few]]
        head = np.flatnonzero(place == 0)
        whole = np.add.reduceat(code[few] * TURNS[place], head) + count[line[few[head]]].astype(U)
        own, token = np.r_[own, line[few[head]]], np.r_[token, mix(whole) >> U(64 - TOKEN)]
        order = np.argsort(own, kind="stable")
        own, token = own[order], token[order]
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, bool), first, count
    behind = np.zeros(len(token), U) if late is None else late.holds(token).astype(U)
    # A sort key holds the line's number among ROOM; a text of more lines is sorted piece by piece.
    lines, keys = [], []
    edge = np.searchsorted(own, np.arange(0, len(starts) + ROOM, ROOM))
    for base, a, b in zip(range(0, len(starts), ROOM), edge[:-1], edge[1:]):
        key = np.sort((own[a:b] - base).astype(U) << U(TOKEN + 1) | behind[a:b] << U(TOKEN) | token[a:b])
        key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
        lines.append((key >> U(TOKEN + 1)).astype(np.int64) + base)
        keys.append(key)
    line, key = np.concatenate(lines), np.concatenate(keys)
    return line, key & U((1 << TOKEN) - 1), (key >> U(TOKEN)) & U(1) > 0, first, count


def heads_of(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line's tokens start, and how many it has."""
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    return head, np.diff(np.r_[head, len(line)])


def classes_of(token: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A fingerprint of each line's set, never zero."""
    if not len(head):
        return np.zeros(0, np.int64)
    return (mix(np.add.reduceat(mix(token ^ U(0x5A5A5A5A5A5A5A5A)), head) + size.astype(U)) | U(1)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc, uid, classes; zero for a line without words) and of shingles (token, times) frequent within a task."""

    def run(batches):
        held, size = [], 0

        def frequent():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            own = n >= OFTEN
            some = int(own.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(some, pa.int64()), pa.nulls(some, pa.int64()), pa.nulls(some, pa.list_(pa.int64())),
                                               pa.array(values[own].astype(np.int64)), pa.array(n[own])], names=["doc", "uid", "classes", "token", "times"])

        for batch in batches:
            for part in slices(batch, "_text"):
                line, token, _, first, count = line_sets(*flat_bytes(part.column("_text")))
                head, n = heads_of(line)
                cls = np.zeros(len(count), np.int64)
                cls[line[head]] = classes_of(token, head, n)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(count)].astype(np.int32)), pa.array(cls))
                some = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("_doc"), part.column("_uid"), lists, pa.nulls(some, pa.int64()), pa.nulls(some, pa.int64())],
                                                 names=["doc", "uid", "classes", "token", "times"])
                held.append(token)
                size += len(token)
                if size > COUNTED:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, "doc long, uid long, classes array<long>, token long, times long")


RECORD = np.dtype([("token", "<u4"), ("n", "<u2"), ("rank", "<u2"), ("cls", "<i8")])
TOP = (1 << 16) - 1


def postings(docs: DataFrame, late_tokens, buckets: int) -> DataFrame:
    """(bucket, records): per task and bucket the leading shingles of its lines, packed."""

    def run(batches):
        held, seen, size, late = [], np.zeros(0, np.int64), 0, Late(late_tokens.value)

        def packed():
            bucket, records = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(bucket, kind="stable")
            bucket, records = bucket[order], records[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edge))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([records[edge[b]: edge[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "records"])

        for batch in batches:
            for part in slices(batch, "_text"):
                line, token, _, _, _ = line_sets(*flat_bytes(part.column("_text")), late)
                head, n = heads_of(line)
                cls = classes_of(token, head, n)
                _, new = np.unique(cls, return_index=True)
                new = np.sort(new[~np.isin(cls[new], seen)])
                seen = cls[new] if len(seen) > 500_000 else np.concatenate([seen, cls[new]])
                lead = n[new] - -(-LIMIT * n[new] // 100) + 1
                at = spread(head[new], lead)
                records = np.empty(len(at), RECORD)
                records["token"] = token[at] & U(0xFFFFFFFF)
                records["n"] = np.repeat(np.minimum(n[new], TOP), lead)
                records["rank"] = np.minimum(at - np.repeat(head[new], lead), TOP)
                records["cls"] = np.repeat(cls[new], lead)
                held.append((((token[at] >> U(16)) % U(buckets)).astype(np.int32), records))
                size += len(at)
                if size > COUNTED:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return docs.mapInArrow(run, "bucket int, records binary")


def close_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether records that meet in a shingle pass the length and the positional filter."""
    nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
    most = np.minimum(nx - x["rank"], ny - y["rank"])
    fits = (100 * np.minimum(nx, ny) >= LIMIT * np.maximum(nx, ny)) & ((100 + LIMIT) * most >= LIMIT * (nx + ny))
    return (fits | (nx == TOP) | (ny == TOP)) & (x["cls"] != y["cls"])


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    some = len(pairs)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(some, pa.int64()), pa.nulls(some, pa.int32()), pa.nulls(some, pa.int32())], names=["a", "b", "token", "n", "rank"])


def meetings(rows: DataFrame, parts: int) -> DataFrame:
    """(a, b) pairs that pass the filters; of shingles with more than HEAVY lines the records (a, token, n, rank)."""

    def close(bucket, blobs):
        r = np.frombuffer(b"".join(blobs), RECORD)
        order = np.argsort(r["token"], kind="stable")
        r = r[order]
        same = r["token"][1:] == r["token"][:-1]
        r = r[np.r_[same, False] | np.r_[False, same]]
        if not len(r):
            return
        # Of two different shingles that look alike here, pairs are dropped by verification.
        r = r[np.lexsort((r["cls"], r["n"], r["token"]))]
        r = r[np.r_[True, (r["token"][1:] != r["token"][:-1]) | (r["cls"][1:] != r["cls"][:-1])]]
        head = np.flatnonzero(np.r_[True, r["token"][1:] != r["token"][:-1]])
        size = np.diff(np.r_[head, len(r)])
        heavy = np.repeat(size > HEAVY, size)
        if heavy.any():
            h = r[heavy]
            yield pa.RecordBatch.from_arrays([pa.array(h["cls"].copy()), pa.nulls(len(h), pa.int64()), pa.array((np.int64(bucket) << 32) + h["token"].astype(np.int64)),
                                              pa.array(h["n"].astype(np.int32)), pa.array(h["rank"].astype(np.int32))], names=["a", "b", "token", "n", "rank"])
        # Partners of a record are those before it in its run that are long enough.
        start = np.repeat(head, size)
        scale = np.repeat(np.arange(len(head), dtype=np.int64) << 17, size)
        from_ = np.searchsorted(scale + r["n"], scale + np.where(r["n"] == TOP, 0, -(-LIMIT * r["n"].astype(np.int64) // 100)))
        at = np.arange(len(r))
        many = np.where(heavy, 0, at - np.maximum(from_, start))
        for lo, hi in chunked(many):
            left, right = spread(np.maximum(from_, start)[lo:hi], many[lo:hi]), np.repeat(at[lo:hi], many[lo:hi])
            ok = close_pairs(r[left], r[right])
            if ok.any():
                yield pair_batch(r["cls"][left[ok]], r["cls"][right[ok]])

    def run(batches):
        bucket, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("records").to_pylist()):
                if b != bucket:
                    if blobs:
                        yield from close(bucket, blobs)
                    bucket, blobs = b, []
                blobs.append(blob)
        if blobs:
            yield from close(bucket, blobs)

    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, token long, n int, rank int")


def chunked(many: np.ndarray):
    """Ranges of rows with about PAIRS partners together."""
    total = np.cumsum(many)
    at = 0
    while at < len(many):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        yield at, stop
        at = stop


def passes(nx: str, rx: str, ny: str, ry: str):
    """``close_pairs`` as a column."""
    small, large = F.least(nx, ny), F.greatest(nx, ny)
    most = F.least(F.col(nx) - F.col(rx), F.col(ny) - F.col(ry))
    return ((100 * small >= LIMIT * large) & ((100 + LIMIT) * most >= LIMIT * (F.col(nx) + F.col(ny)))) | (large == TOP)


def first_meetings(records: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of each line of a heavy shingle with the earliest line of it, and the earliest (token, hub)."""
    placed = records.join(firsts.select(F.col("cls").alias("_c"), "at"), F.col("a") == F.col("_c")).drop("_c")
    hubs = placed.groupBy(F.col("token").alias("_t")).agg(F.min_by(F.struct("a", "n", "rank"), "at").alias("h")).select("_t", F.col("h.a").alias("hub"), F.col("h.n").alias("hn"), F.col("h.rank").alias("hr"))
    met = records.join(hubs, F.col("token") == F.col("_t")).where((F.col("a") != F.col("hub")) & passes("n", "rank", "hn", "hr"))
    return met.select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b")), hubs.select("_t", "hub")


def heavy_meetings(records: DataFrame, parts: int) -> DataFrame:
    """(a, b) pairs of heavy shingles with an ``open`` line: every pair of blocks of a shingle's lines is a group of its own."""
    sizes = records.groupBy(F.col("token").alias("_t")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.bool_or("open").alias("_any")).where("_any").drop("_any")
    cut = records.join(sizes, F.col("token") == F.col("_t")).withColumn("own", F.pmod(F.xxhash64("a", F.lit(3)), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "a", "n", "rank", "open")

    def close(key, group):
        left, cls, n, rank, open_ = (np.array(c) for c in group)
        r = np.empty(len(cls), RECORD)
        r["cls"], r["n"], r["rank"], r["token"] = cls, n, rank, 0
        sides = [(r[open_], r)] if key[1] == key[2] else [(r[left & open_], r[~left]), (r[~left & open_], r[left])]
        for x, y in sides:
            step = max(1, PAIRS // max(1, len(y)))
            for at in range(0, len(x), step):
                part = x[at: at + step]
                a, b = np.repeat(part, len(y)), np.tile(y, len(part))
                ok = close_pairs(a, b)
                if ok.any():
                    yield pair_batch(a["cls"][ok], b["cls"][ok])

    def run(batches):
        key, group = None, ([], [], [], [], [])
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("token", "i", "j")))
            for k, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in ("left", "a", "n", "rank", "open")))):
                if k != key:
                    if group[0]:
                        yield from close(key, group)
                    key, group = k, ([], [], [], [], [])
                for c, x in zip(group, row):
                    c.append(x)
        if group[0]:
            yield from close(key, group)

    dealt = cut.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(run, "a long, b long, token long, n int, rank int").select("a", "b")


def sets_of(docs: DataFrame, bloom, texts) -> DataFrame:
    """(cls, n, shingles) of the lines whose class the first filter knows, in texts that the second knows."""

    def known(words, values):
        h = mix(values.view(U))
        return (words[(h >> U(6)).astype(np.int64) % BLOOM_WORDS] >> (h & U(63))) & U(1) > 0

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(known(texts.value, batch.column("_uid").to_numpy())))
            for part in slices(batch, "_text"):
                line, token, _, _, _ = line_sets(*flat_bytes(part.column("_text")))
                head, n = heads_of(line)
                cls = classes_of(token, head, n)
                own = np.flatnonzero(known(bloom.value, cls))
                _, at = np.unique(cls[own], return_index=True)
                own = own[at]
                raw = token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                yield pa.RecordBatch.from_arrays([pa.array(cls[own]), pa.array(n[own]), pa.array([raw[h: h + m].tobytes() for h, m in zip(head[own], n[own])], pa.binary())], names=["cls", "n", "shingles"])

    return docs.mapInArrow(run, "cls long, n long, shingles binary")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the limit."""
    x = sets.select(F.col("cls").alias("_x"), F.col("n").alias("nx"), F.col("shingles").alias("sx"))
    y = sets.select(F.col("cls").alias("_y"), F.col("n").alias("ny"), F.col("shingles").alias("sy"))
    both = pairs.join(x, F.col("a") == F.col("_x")).join(y, F.col("b") == F.col("_y")).select("a", "b", "nx", "ny", "sx", "sy")

    def run(batches):
        for batch in batches:
            out = ([], [])
            for a, b, n, m, p, q in zip(*(c.to_pylist() for c in batch.columns)):
                small, large = shingle_values(p), shingle_values(q)
                if len(small) > len(large):
                    small, large = large, small
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                if 100 * common >= LIMIT * (n + m - common):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def decisions(docs: DataFrame) -> DataFrame:
    """(uid, long_lines, kept): the lines with words of each text, and those of them that stay; ``docs`` has _doc, _uid, _text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = cut_lineage(sketches(docs))
    table = first.where("token is null").select("doc", "uid", "classes")
    often = first.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT)
    late = np.sort(often.select("token").toPandas()["token"].to_numpy(np.int64).view(U))  # FREQUENT numbers at most
    met = cut_lineage(meetings(postings(docs, spark.sparkContext.broadcast(late), parts), parts))
    each = table.select("doc", "uid", F.posexplode("classes").alias("line", "cls")).where("cls <> 0")
    firsts = cut_lineage(each.groupBy("cls").agg(F.min(F.struct("doc", "uid", "line")).alias("at")))
    # Lines of a heavy shingle first meet its earliest line alone.
    heavy = met.where("b is null").select("a", "token", "n", "rank").distinct()
    star, hubs = first_meetings(heavy, firsts)
    pairs = cut_lineage(met.where("b is not null").select("a", "b").unionAll(star).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_c")).unionAll(heavy.select("a")).distinct()
    needed = firsts.join(wanted, F.col("cls") == F.col("_c"), "left_semi").select("cls", F.col("at.uid").alias("uid"))
    bloom = spark.sparkContext.broadcast(bloom_of(needed.select(F.col("cls").alias("uid"))))
    texts = spark.sparkContext.broadcast(bloom_of(needed.select("uid")))
    sets = cut_lineage(sets_of(docs, bloom, texts).dropDuplicates(["cls"]))
    at = firsts.select(F.col("cls").alias("_c"), "at")

    def later(some: DataFrame) -> DataFrame:
        placed = similar(some, sets).join(at, F.col("a") == F.col("_c")).select("a", "b", F.col("at").alias("at_a")).join(at, F.col("b") == F.col("_c"))
        return cut_lineage(placed.select(F.when(F.col("at_a") < F.col("at"), F.col("b")).otherwise(F.col("a")).alias("_late")).distinct())

    # The later line of a pair is decided. Lines still open then meet all others of their shingles.
    beaten = later(pairs)
    still = heavy.join(beaten.withColumn("_beaten", F.lit(True)), F.col("a") == F.col("_late"), "left").join(hubs, F.col("token") == F.col("_t"))
    still = still.select("a", "token", "n", "rank", (F.col("_beaten").isNull() & (F.col("a") != F.col("hub"))).alias("open"))
    rest = heavy_meetings(cut_lineage(still), parts).distinct()
    rest = rest.join(pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
    beaten = beaten.unionAll(later(rest)).distinct()
    stays = firsts.join(beaten, F.col("cls") == F.col("_late"), "left_anti")
    kept = stays.groupBy(F.col("at.uid").alias("_u")).agg(F.collect_list("at.line").alias("kept"))
    lines = F.filter(F.transform("classes", lambda c, i: F.when(c != 0, i)), lambda i: i.isNotNull())
    longs = table.select("uid", lines.alias("long_lines")).dropDuplicates(["uid"])
    out = longs.join(kept, F.col("uid") == F.col("_u"), "left").select("uid", "long_lines", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    return out.where(F.size("long_lines") > F.size("kept"))


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the repeated lines taken out of ``text``, and two more columns: _lines and _removed (long)."""
    names = df.columns
    safe = df.toDF(*[f"_c{i}" for i in range(len(names))])
    doc, body = F.col(f"_c{names.index(key)}").cast("long"), F.col(f"_c{names.index(text)}")
    safe = safe.withColumn("_doc", doc).withColumn("_text", body).withColumn("_uid", F.xxhash64("_doc", F.coalesce("_text", F.lit(""))))
    plan = decisions(safe.select("_doc", "_uid", "_text"))
    joined = safe.drop("_doc", "_text").join(plan, F.col("_uid") == F.col("uid"), "left")
    lines = F.split(body, "\n", -1)
    gone = F.array_except("long_lines", "kept")
    left = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))
    new = F.when(F.col("uid").isNull(), body).otherwise(F.array_join(left, "\n"))
    counted = [F.coalesce(F.size(lines), F.lit(0)).cast("long"), F.coalesce(F.size(gone), F.lit(0)).cast("long")]
    out = joined.select(*[new.alias(f"_c{i}") if n == text else F.col(f"_c{i}") for i, n in enumerate(names)],
                        F.when(body.isNull(), F.lit(0)).otherwise(counted[0]).alias("_lines"), F.when(F.col("uid").isNull(), F.lit(0)).otherwise(counted[1]).alias("_removed"))
    return out.toDF(*names, "_lines", "_removed")


def line_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_removed, kept_sha256), one row per input row; the digest is of the text that is left."""
    out = drop_repeated_lines(df.select(key, text), key, text)
    return out.select(key, F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
