"""Operator 1: exact Jaccard join of word-shingle sets with signature trees.

Equal sets are one class. Two sets at or above the limit share one of their first n - ceil(t n) + 1 shingles in any common
order; shingles come by fingerprint, except that the most frequent ones of all texts (a bounded list) come last. So linked
classes meet in a group of a shared shingle. What two classes share of their first shingles is counted over the small groups, which
parts those that meet by chance. Within a group the members, by size, are the leaves of a tree whose nodes
hold the OR of their members' token bitmaps, their size range and their least number of bits. Two nodes are
compared no further if their sizes are too far apart, if their bitmaps leave too little overlap, or if all below them is
one component already. What is left is verified on the whole sets.

Components are found in two rounds: first every member of a group against the group's most central member, then all
pairs across the components still apart. Where those are many, as in a group of near copies close to the limit, the sets come to the block
and only links which join something leave it. Groups beyond BLOCK members are cut into blocks, and pairs of blocks go to
different tasks. Nothing is capped: the rounds only order the work.

Null and empty texts and texts without words have no shingles, no link, and are their own component. A text of fewer
words than a shingle has one shingle of all its words. Repeated rows are documents like any other, as are those with a null id: they link, but give no
component its id, which is null only where no member has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.common import flat_bytes, mix, slices
from evenhand.llm.components import components
from evenhand.llm.shingles import WORDS, shingle_sets
from evenhand.session import cut_lineage

LIMIT = 75  # percent
FREQUENT = 1 << 18  # shingles that come last in the order, at most
COUNTED = 1 << 22  # shingles a task counts at a time
OFTEN = 4  # occurrences among those from which a shingle is reported
BLOCK = 1024
SMALL = 16  # members of a group whose pairs are counted one by one
FAR = 1 << 40  # more shingles than any set has
LEAF, FAN = 16, 8
DENSE = 8  # pairs to verify for each member of a block beyond which the sets come to the block
STARS = 4  # groups in which a class meets the centre before all others
BLOOM_WORDS = 1 << 18  # 64-bit words of the filter for texts whose sets are needed
U = np.uint64


def class_of(own: np.ndarray) -> int:
    return int(mix(np.array([mix(own ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U) + U(len(own))], U)).view(np.int64)[0])


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (doc, uid, n, cls) and of shingles (token, times) that are frequent within a task."""

    def run(batches):
        held, size = [], 0

        def frequent():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            own = n >= OFTEN
            some = int(own.sum())
            return pa.RecordBatch.from_arrays([*[pa.nulls(some, pa.int64())] * 4, pa.array(values[own].view(np.int64)), pa.array(n[own])],
                                              names=["doc", "uid", "n", "cls", "token", "times"])

        for batch in batches:
            for part in slices(batch, "_text"):
                n, cls = [], []
                for own in shingle_sets(*flat_bytes(part.column("_text")), k):
                    n.append(len(own))
                    cls.append(class_of(own) if len(own) else None)
                    held.append(own)
                    size += len(own)
                yield pa.RecordBatch.from_arrays([part.column("_doc"), part.column("_uid"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), *[pa.nulls(len(n), pa.int64())] * 2],
                                                 names=["doc", "uid", "n", "cls", "token", "times"])
                if size > COUNTED:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, "doc long, uid long, n long, cls long, token long, times long")


def postings(docs: DataFrame, frequent, buckets: int, k: int, limit: int) -> DataFrame:
    """(bucket, tokens, classes): per task and bucket the leading shingles of its classes, packed."""

    def run(batches):
        late = frequent.value
        tokens, classes, seen, size = [], [], set(), 0

        def packed():
            t, c = np.concatenate(tokens), np.concatenate(classes)
            bucket = (t >> U(32)) % U(buckets)
            order = np.argsort(bucket, kind="stable")
            t, c, bucket = (t[order] & U(0xFFFFFFFF)).astype("<u4"), c[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edge))
            return pa.RecordBatch.from_arrays([
                pa.array(some.astype(np.int32)), pa.array([t[edge[b]: edge[b + 1]].tobytes() for b in some], pa.binary()),
                pa.array([c[edge[b]: edge[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "tokens", "classes"])

        for batch in batches:
            for part in slices(batch, "_text"):
                for own in shingle_sets(*flat_bytes(part.column("_text")), k):
                    n = len(own)
                    cls = class_of(own) if n else None
                    if cls is None or cls in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(cls)
                    lead = n - -(-limit * n // 100) + 1
                    if len(late):
                        at = np.minimum(np.searchsorted(late, own), len(late) - 1)
                        known = late[at] == own
                        if known.any():
                            own = np.concatenate([own[~known], own[known]])
                    tokens.append(own[:lead])
                    classes.append(np.full(lead, cls, np.int64))
                    size += lead
                if size > COUNTED:
                    yield packed()
                    tokens, classes, size = [], [], 0
        if tokens:
            yield packed()

    return docs.mapInArrow(run, "bucket int, tokens binary, classes binary")


def groups_of(rows: DataFrame, parts: int) -> DataFrame:
    """(gid, chunk, chunks, shared, members): the distinct sets of classes that share leading shingles, and how many they share."""

    def close(tokens, classes):
        t = np.frombuffer(b"".join(tokens), "<u4")
        c = np.frombuffer(b"".join(classes), np.int64)
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        same = t[1:] == t[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        t, c = t[keep], c[keep]
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        fresh = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])] if len(t) else np.zeros(0, bool)
        t, c = t[fresh], c[fresh]
        head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        if not len(head):
            return
        size = np.diff(np.r_[head, len(t)])
        gid = mix(np.add.reduceat(mix(c.view(U)), head) + size.astype(U)).view(np.int64)
        _, first, times = np.unique(gid, return_index=True, return_counts=True)
        out = ([], [], [], [], [])
        for g, shared in zip(first[size[first] > 1].tolist(), times[size[first] > 1].tolist()):
            a, n = head[g], size[g]
            for j in range(0, n, BLOCK):
                for col, x in zip(out, (gid[g], j // BLOCK, -(-n // BLOCK), shared, c[a + j: a + min(n, j + BLOCK)])):
                    col.append(x)
        if out[0]:
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in out[4]])].astype(np.int32)), pa.array(np.concatenate(out[4])))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), lists],
                                             names=["gid", "chunk", "chunks", "shared", "members"])

    def run(batches):
        bucket, tokens, classes = None, [], []
        for batch in batches:
            for b, t, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "tokens", "classes"))):
                if b != bucket:
                    if tokens:
                        yield from close(tokens, classes)
                    bucket, tokens, classes = b, [], []
                tokens.append(t)
                classes.append(c)
        if tokens:
            yield from close(tokens, classes)

    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket")
    made = dealt.mapInArrow(run, "gid long, chunk int, chunks int, shared long, members array<long>")
    return made.groupBy("gid", "chunk").agg(F.first("chunks").alias("chunks"), F.sum("shared").alias("shared"), F.first("members").alias("members"))


def possible(groups: DataFrame, sizes: DataFrame, parts: int, limit: int) -> DataFrame:
    """(gid, chunk, chunks, cls, size): the members of each group that may have a partner in it, and how many they are.

    Of two sets, all common shingles up to the end of the shorter lead are counted in both leads, so their overlap is at
    most the number of leading shingles they share and what follows the longer lead. What two classes share is counted pair by pair
    over the groups of up to SMALL members; to that comes at most what the lesser of them has in all larger groups. A pair that passes
    stays in the largest small group it shares. One that shares none must pass by its larger groups alone; of those, the groups of several
    chunks keep all members.
    """
    wide = (F.col("chunks") > 1) | (F.size("members") > SMALL)
    members = groups.select("gid", "chunk", "chunks", "shared", wide.alias("wide"), F.explode("members").alias("cls"))
    shares = members.groupBy("cls").agg(F.sum("shared").alias("most"), F.sum(F.when(F.col("wide"), F.col("shared")).otherwise(0)).alias("big"))
    shares = shares.join(sizes.select(F.col("cls").alias("_c"), "n"), F.col("cls") == F.col("_c")).select("_c", "most", "big", "n")
    rows = members.join(shares, F.col("cls") == F.col("_c")).select("gid", "chunk", "chunks", "wide", "shared", "cls", "most", "big", "n")

    def lacking(most, n):
        """How many more leading shingles two sets must share than the lesser of their ``most``; beyond any number where sizes are too far apart."""
        after = -(-limit * n // 100) - 1
        least, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
        overlap = -(-limit * (n[:, None] + n[None, :]) // (100 + limit))
        out = overlap - np.maximum(after[:, None], after[None, :]) - np.minimum(most[:, None], most[None, :])
        return np.where(100 * least >= limit * large, out, FAR)

    def run(batches):
        def flush():
            gid, chunk, chunks, wide, shared = key
            cls, most, big, n = (np.array(x) for x in group)
            if not wide:
                a, b = np.nonzero(np.triu((lacking(most, n) <= 0), 1))
                kept, other, need = cls[a].tolist(), cls[b].tolist(), lacking(big, n)[a, b].tolist()
            elif chunks == 1:
                ok = lacking(big, n) <= 0
                np.fill_diagonal(ok, False)
                kept = cls[ok.any(axis=1)].tolist()
                other = need = [None] * len(kept)
            else:
                kept = cls.tolist()
                other = need = [None] * len(kept)
            for c, x in zip(out, (gid, chunk, chunks, kept, len(kept) if wide else len(cls), other, shared, need)):
                c += x if isinstance(x, list) else [x] * len(kept)

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds.values())], names=list(kinds))

        kinds = {"gid": pa.int64(), "chunk": pa.int32(), "chunks": pa.int32(), "cls": pa.int64(), "size": pa.int32(), "other": pa.int64(), "shared": pa.int64(), "need": pa.int64()}
        key, group, out = None, ([], [], [], []), tuple([] for _ in kinds)
        for batch in batches:
            for *own, cls, most, big, n in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if group[0]:
                        flush()
                    key, group = own, ([], [], [], [])
                for c, x in zip(group, (cls, most, big, n)):
                    c.append(x)
            if len(out[0]) > 100_000:
                yield made()
                out = tuple([] for _ in kinds)
        if group[0]:
            flush()
        yield made()

    schema = "gid long, chunk int, chunks int, cls long, size int, other long, shared long, need long"
    made = cut_lineage(rows.repartition(parts, "gid", "chunk").sortWithinPartitions("gid", "chunk").mapInArrow(run, schema))
    pairs = made.where("other is not null").groupBy("cls", "other").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"), F.max(F.struct("size", "gid")).alias("top"))
    near = pairs.where("shared >= need").select("top.gid", F.lit(0).alias("chunk"), F.lit(1).alias("chunks"), F.explode(F.array("cls", "other")).alias("cls"), "top.size").distinct()
    return made.where("other is null").select(*near.columns).unionAll(near)


def bitmap(own: np.ndarray) -> np.ndarray:
    """Four to eight bits per shingle, a power of two of 64-bit words."""
    size = 1 << max(0, (4 * len(own) - 1).bit_length() - 6)
    out = np.zeros(size, U)
    bit = own % U(64 * size)
    np.bitwise_or.at(out, (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap (last axis) of fewer words: a bit goes to its place modulo the new width."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def sets_of(docs: DataFrame, bloom, k: int, whole: bool) -> DataFrame:
    """(cls, n, bits) of the texts whose number the filter knows, and on request their shingles.

    A task gives a class once. Tasks that hold equal rows, or a text that the filter takes for another, give it again, which
    changes nothing for those who read it; so the sets stay where they are made.
    """
    kinds = {"cls": pa.int64(), "n": pa.int64(), "bits": pa.binary()} | ({"shingles": pa.binary()} if whole else {})

    def run(batches):
        words, seen = bloom.value, set()
        for batch in batches:
            ids = mix(batch.column("_uid").to_numpy().view(U))
            known = (words[(ids >> U(6)).astype(np.int64) % len(words)] >> (ids & U(63))) & U(1) > 0
            batch = batch.filter(pa.array(known))
            for part in slices(batch, "_text"):
                out = tuple([] for _ in kinds)
                for own in shingle_sets(*flat_bytes(part.column("_text")), k):
                    cls = class_of(own) if len(own) else None
                    if cls is None or cls in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(cls)
                    row = (cls, len(own), bitmap(own).tobytes())
                    if whole:
                        # Six bytes a shingle tell sets apart: two texts of 20,000 words confuse one pair in a million.
                        row += (np.unique(own >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),)
                    for c, x in zip(out, row):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds.values())], names=list(kinds))

    return docs.mapInArrow(run, "cls long, n long, bits binary" + ", shingles binary" * whole)


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over the numbers in column ``uid``."""

    def run(batches):
        for batch in batches:
            h = mix(batch.column("uid").to_numpy().view(U))
            yield pa.RecordBatch.from_arrays([pa.array((h >> U(6)).astype(np.int64) % BLOOM_WORDS), pa.array((U(1) << (h & U(63))).view(np.int64))], names=["word", "bit"])

    out = np.zeros(BLOOM_WORDS, np.int64)
    rows = ids.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # BLOOM_WORDS rows at most
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(U)


def shingle_values(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :6] = part
    return out.view("<u8").reshape(-1)


class Node:
    __slots__ = ("lo", "hi", "bits", "pop", "part", "kids", "rows")

    def __init__(self, lo, hi, bits, pop, part, kids, rows):
        self.lo, self.hi, self.bits, self.pop, self.part, self.kids, self.rows = lo, hi, bits, pop, part, kids, rows


def tree(n: np.ndarray, bits: list[np.ndarray], part: np.ndarray, rows: np.ndarray) -> Node:
    """The signature tree over ``rows``, which come by size."""
    level = []
    for a in range(0, len(rows), LEAF):
        own = rows[a: a + LEAF]
        width = min(len(bits[r]) for r in own)
        stack = np.stack([fold(bits[r], width) for r in own])
        parts = part[own]
        level.append(Node(n[own[0]], n[own[-1]], np.bitwise_or.reduce(stack), int(np.bitwise_count(stack).sum(axis=1).min()),
                          parts[0] if (parts == parts[0]).all() else None, None, (own, stack)))
    while len(level) > 1:
        upper = []
        for a in range(0, len(level), FAN):
            kids = level[a: a + FAN]
            width = min(len(x.bits) for x in kids)
            # Folding may merge bits, so a node of mixed widths promises none.
            pop = min(x.pop for x in kids) if all(len(x.bits) == width for x in kids) else 0
            one = kids[0].part if all(x.part is not None and x.part == kids[0].part for x in kids) else None
            upper.append(Node(kids[0].lo, kids[-1].hi, np.bitwise_or.reduce([fold(x.bits, width) for x in kids]), pop, one, kids, None))
        level = upper
    return level[0]


def apart(a: Node, b: Node, limit: int) -> bool:
    """Whether no pair below the nodes can be a new link."""
    if a.part is not None and a.part == b.part or 100 * a.hi < limit * b.lo or 100 * b.hi < limit * a.lo:
        return True
    if len(a.bits) != len(b.bits):
        return False
    common = int(np.bitwise_count(a.bits & b.bits).sum())
    most = min(a.hi - max(0, a.pop - common), b.hi - max(0, b.pop - common))
    return (100 + limit) * most < limit * (a.lo + b.lo)


def leaf_pairs(a: Node, b: Node, n: np.ndarray, part: np.ndarray, limit: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    (ra, sa), (rb, sb) = a.rows, b.rows
    width = min(sa.shape[1], sb.shape[1])
    x, y = fold(sa, width)[:, None, :], fold(sb, width)[None, :, :]
    na, nb = n[ra][:, None], n[rb][None, :]
    most = np.minimum(na - np.bitwise_count(x & ~y).sum(axis=2, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(axis=2, dtype=np.int64))
    ok = ((100 + limit) * most >= limit * (na + nb)) & (part[ra][:, None] != part[rb][None, :])
    i, j = np.nonzero(np.triu(ok, 1) if same else ok)
    return ra[i], rb[j]


def dual(a: Node, b: Node, n, part, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The row pairs that the trees leave to verify; ``a is b`` for pairs within one tree."""
    out, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        if apart(a, b, limit):
            continue
        if a.kids is None and b.kids is None:
            out.append(leaf_pairs(a, b, n, part, limit, a is b))
        elif a is b:
            todo += [(x, y) for i, x in enumerate(a.kids) for y in a.kids[i:]]
        elif b.kids is None or a.kids is not None and a.hi - a.lo > b.hi - b.lo:
            todo += [(x, b) for x in a.kids]
        else:
            todo += [(a, y) for y in b.kids]
    return out


def central(bits: list[np.ndarray]) -> tuple[int, float]:
    """The member nearest to the majority of the bitmaps, and how near."""
    width = min(map(len, bits))
    table = np.unpackbits(np.stack([fold(b, width) for b in bits]).view(np.uint8), axis=1).astype(np.float32)
    score = table @ (2 * table.mean(axis=0) - 1)
    at = int(score.argmax())
    return at, float(score[at] / max(1, width))


def linked(own: np.ndarray, other: np.ndarray, n: int, m: int, limit: int) -> bool:
    """Whether two sets of n and m shingles reach the limit."""
    small, large = (own, other) if len(own) < len(other) else (other, own)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= limit * (n + m - common)


def spanning(a: np.ndarray, b: np.ndarray, part: np.ndarray, n: np.ndarray, raw: list[bytes], limit: int) -> list[tuple[int, int]]:
    """Of the pairs those that link two parts not yet joined: a forest of the parts, at most one edge less than there are members."""
    root: dict = {}
    sets: dict = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    def own(r):
        if r not in sets:
            sets[r] = shingle_values(raw[r])
        return sets[r]

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(part[x]), find(part[y])
        if p != q and linked(own(x), own(y), int(n[x]), int(n[y]), limit):
            root[p] = q
            out.append((x, y))
    return out


def candidates(rows: DataFrame, parts: int, limit: int, mode: str) -> DataFrame:
    """(a, b, gid, i, j, score) of groups. Rows: gid, i, j, side, cls, n, bits, part, lead; side 2 is both sides, lead marks a given centre.

    ``star``: each member meets the group's centre alone and the pairs are to be verified; a group of several blocks without a given
    centre only names its own (b null). Otherwise the signature trees of the two sides are traversed together. ``pairs``: where they leave
    no more than DENSE pairs for each member of the block, those are to be verified; else only the members concerned are named (b null).
    ``links``: what the trees leave is verified on the sets at hand (column shingles), and the links that join something come out. So the
    rows of a block grow with its members, not with their square.
    """

    most = DENSE

    def one(gid, blocks, group):
        side, cls, n, bits, part, lead = (np.array(c) if k in (0, 1, 2, 4, 5) else [np.frombuffer(x, U) for x in c] for k, c in enumerate(group[:6]))
        if mode == "star":
            given = np.flatnonzero(lead)
            at, score = (int(given[0]), 0.0) if len(given) else central(bits)
            if blocks > 1 and not len(given):
                return [cls[at]], [None], [score]
            order = np.array([r for r in range(len(cls)) if cls[r] != cls[at]], np.int64)
            order = order[np.argsort(n[order], kind="stable")]
            if not len(order):
                return [], [], []
            pairs = dual(tree(n, bits, part, order), tree(n, bits, part, np.array([at])), n, part, limit)
        else:
            own = [np.flatnonzero(side == s) for s in ((2,) if (side == 2).all() else (0, 1))]
            if not all(map(len, own)):
                return [], [], []
            trees = [tree(n, bits, part, o[np.argsort(n[o], kind="stable")]) for o in own]
            pairs = dual(trees[0], trees[-1], n, part, limit)
            a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
            if mode == "links":
                found = spanning(a, b, part, n, group[6], limit)
                return [int(cls[x]) for x, _ in found], [int(cls[y]) for _, y in found], [0.0] * len(found)
            if len(a) > most * len(cls):
                some = np.unique(cls[np.r_[a, b]]).tolist()
                return some, [None] * len(some), [0.0] * len(some)
            return cls[a].tolist(), cls[b].tolist(), [0.0] * len(a)
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        return cls[a].tolist(), cls[b].tolist(), [0.0] * len(a)

    names = ("side", "cls", "n", "bits", "part", "lead") + (("shingles",) if mode == "links" else ())

    def run(batches):
        def close():
            a, b, score = one(key[0], key[3], group)
            place = [pa.array([key[c]] * len(a), t) for c, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *place, pa.array(score, pa.float64())], names=["a", "b", "gid", "i", "j", "score"])

        key, group, met = None, [[] for _ in names], set()
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("gid", "i", "j", "blocks")))
            for k, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in names))):
                if k != key:
                    if group[0]:
                        yield close()
                    key, group, met = k, [[] for _ in names], set()
                if row[1] in met:  # a class whose set came from several tasks
                    continue
                met.add(row[1])
                for c, x in zip(group, row):
                    c.append(x)
        if group[0]:
            yield close()

    dealt = rows.select("gid", "i", "j", "blocks", *names).repartition(parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j")
    return dealt.mapInArrow(run, "a long, b long, gid long, i int, j int, score double")


def verified(pairs: DataFrame, sets: DataFrame, parts: int, limit: int) -> DataFrame:
    """The pairs (a, b) at or above the limit, their ends perhaps exchanged."""
    own = sets.select(F.col("cls").alias("_c"), "n", "shingles")
    # Every pair goes to the end with more pairs, whose set then moves once for up to 64 of them.
    degree = pairs.select(F.explode(F.array("a", "b")).alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("k"))
    of = lambda c: degree.select(F.col("_d").alias(f"_{c}"), F.col("k").alias(f"k{c}"))
    both = pairs.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b"))
    turn = F.col("ka") >= F.col("kb")
    turned = both.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("ka", "kb").alias("k"))
    turned = cut_lineage(turned.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / 64)).cast("int").alias("salt")))
    right = turned.join(own, F.col("b") == F.col("_c")).select("a", "salt", "b", "n", "shingles")
    left = turned.select("a", "salt").distinct().join(own, F.col("a") == F.col("_c")).select("a", "salt", F.lit(None).cast("long").alias("b"), "n", "shingles")

    def run(batches):
        key, n, own = None, 0, None
        for batch in batches:
            out = ([], [])
            for a, salt, b, m, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "n", "shingles"))):
                if b is None:
                    key, n, own = a, m, shingle_values(raw)
                    continue
                if linked(own, shingle_values(raw), n, m, limit):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    dealt = left.unionAll(right).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def links(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, k: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, n, cls) and the component (cls, component) of every class that is linked with a smaller one."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))
    docs = docs.withColumn("_uid", F.xxhash64("_doc", "_text"))  # null ids are rows like any other
    first = cut_lineage(sketches(docs, k))
    table = first.where("token is null").select("doc", "uid", "n", "cls")
    often = first.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT)
    late = np.sort(often.select("token").toPandas()["token"].to_numpy(np.int64).view(U))  # FREQUENT numbers at most
    groups = cut_lineage(groups_of(postings(docs, spark.sparkContext.broadcast(late), parts, k, limit), parts))
    members = cut_lineage(possible(groups, table.where("cls is not null").groupBy("cls").agg(F.first("n").alias("n")), parts, limit))
    of_class = table.where("cls is not null").groupBy("cls").agg(F.min("uid").alias("uid"))

    def sets(classes: DataFrame, whole: bool = True) -> DataFrame:
        """The sets of some classes, made again from their texts: a scan more, but only sets that are compared are ever stored or moved."""
        needed = of_class.join(classes.toDF("_c").distinct(), F.col("cls") == F.col("_c"), "left_semi")
        return cut_lineage(sets_of(docs, spark.sparkContext.broadcast(bloom_of(needed.select("uid"))), k, whole))

    def ends(of: DataFrame) -> DataFrame:
        return of.select(F.explode(F.array("a", "b")))

    small = sets(members.select("cls"), whole=False).withColumnRenamed("cls", "_c")

    def rows(of: DataFrame) -> DataFrame:
        return of.join(small, F.col("cls") == F.col("_c")).drop("_c")

    def centre(of: DataFrame) -> DataFrame:
        plain = of.select("gid", F.col("chunk").alias("i"), F.col("chunk").alias("j"), F.col("chunks").alias("blocks"), F.lit(2).alias("side"), "cls", F.col("cls").alias("part"), "lead")
        return candidates(rows(plain), parts, limit, "star")

    # Round one: the centre of each group, for each class in its largest groups.
    rank = F.row_number().over(W.partitionBy("cls").orderBy(F.desc("chunks"), F.desc("size"), "gid"))
    largest = cut_lineage(members.withColumn("rank", rank).where(F.col("rank") <= STARS).select("gid", "chunk", "chunks", "cls"))
    star = cut_lineage(centre(largest.withColumn("lead", F.lit(0))))
    hubs = star.where("b is null").groupBy("gid").agg(F.max_by("a", F.struct("score", "a")).alias("hub"))
    large = largest.where("chunks > 1").join(hubs.select(F.col("gid").alias("_g"), "hub"), F.col("gid") == F.col("_g")).drop("_g")
    given = large.select("gid", "chunk", "chunks", F.col("hub").alias("cls")).distinct().withColumn("lead", F.lit(1))
    # Written first: groups of several blocks are few, and the bitmaps are then not moved to meet them.
    more = centre(cut_lineage(large.where("cls <> hub").select("gid", "chunk", "chunks", "cls").withColumn("lead", F.lit(0)).unionAll(given)))
    pairs = star.where("b is not null").select("a", "b").unionAll(more.where("b is not null").select("a", "b"))
    pairs = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges = cut_lineage(verified(pairs, sets(ends(pairs)), parts, limit))
    parts1 = cut_lineage(components(edges))
    # Round two: what is still apart within a group.
    known = members.join(parts1, F.col("cls") == F.col("node"), "left").select("gid", "chunk", "chunks", "cls", F.coalesce("component", "cls").alias("part"))
    known = cut_lineage(known)
    split = known.groupBy(F.col("gid").alias("_g")).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("_g")
    open_ = known.join(split, F.col("gid") == F.col("_g"), "left_semi")
    blocks = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = blocks.select("gid", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), F.col("chunks").alias("blocks"),
                           F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side"), "cls", "part", F.lit(0).alias("lead"))
    left = cut_lineage(candidates(rows(blocks), parts, limit, "pairs"))
    rest = left.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = cut_lineage(rest.join(pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"))
    dense = left.where("b is null").select(F.col("gid").alias("_g"), F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("a").alias("_m"))
    within = blocks.join(dense, (F.col("gid") == F.col("_g")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & (F.col("cls") == F.col("_m"))).drop("_g", "_i", "_j", "_m")
    within = cut_lineage(within)
    some = sets(ends(rest).unionAll(dense.select("_m")))
    within = within.join(some.withColumnRenamed("cls", "_c"), F.col("cls") == F.col("_c")).drop("_c")
    more_edges = cut_lineage(verified(rest, some, parts, limit).unionAll(candidates(within, parts, limit, "links").select("a", "b")))
    return table, components(edges.unionAll(more_edges)).select(F.col("node").alias("cls"), "component")


def with_components(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, k: int = WORDS) -> DataFrame:
    """(key, n_shingles, component_id), one row per input row: the smallest key that links lead to."""
    table, linked = links(df, key, text, limit, k)
    classes = table.where("cls is not null").groupBy("cls").agg(F.min("doc").alias("least"))
    part = classes.join(linked.select(F.col("cls").alias("_c"), "component"), F.col("cls") == F.col("_c"), "left").select("cls", "least", F.coalesce("component", "cls").alias("part"))
    part = cut_lineage(part)
    least = part.groupBy(F.col("part").alias("_p")).agg(F.min("least").alias("smallest"))
    named = part.join(least, F.col("part") == F.col("_p")).select(F.col("cls").alias("_c"), "smallest")
    out = table.join(named, F.col("cls") == F.col("_c"), "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose key is the smallest of its component, with all their columns.

    Of rows that repeat both key and text one stays; rows that repeat a kept key with another text stay.
    """
    parts = with_components(df.select(key, text), key, text, **options)
    keep = parts.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept")).distinct()
    names = df.columns
    safe = df.toDF(*[f"_c{i}" for i in range(len(names))])
    own, body = F.col(f"_c{names.index(key)}"), F.col(f"_c{names.index(text)}")
    kept = safe.join(keep, own.cast("long").eqNullSafe(F.col("_kept")), "left_semi").withColumn("_same", F.xxhash64(F.coalesce(body, F.lit(""))))
    return kept.dropDuplicates([f"_c{names.index(key)}", "_same"]).drop("_same").toDF(*names)
