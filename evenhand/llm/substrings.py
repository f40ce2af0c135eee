"""Operator 10: removal of every byte that a repeated 400-byte string covers, by prefix-free parsing.

Parsing. The fingerprint of every GRAM bytes is a rolling hash; a place triggers if it is the least (the rightmost of equal
ones) among REACH consecutive places. Every string of SPAN bytes has such a trigger in its first REACH places, the
same one wherever the string stands, and the phrase of SPAN - REACH + 1 bytes from there on lies inside the string. (Triggers
by a fixed remainder leave texts without any; the least of a window never does.)

Dictionary and parse. Starts of strings fall to their trigger. Sorting the parse by phrase and surroundings brings equal
phrases together in corpus order: a phrase seen once is done with, and starts whose whole surroundings occur twice are
repeated. Where one phrase has several surroundings (the ends of repeated passages), the strings of one occurrence of each
are compared, the suffixes of the dictionary entry in their order. Order and equality go by 64-bit fingerprints.

Texts and surroundings that repeat within a task are folded before anything is moved. Rows with equal key and text are
documents of their own, so all their strings repeat. Null counts as empty; texts under SPAN bytes stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import Rolling, flat_bytes, mix, slices, spread
from evenhand.session import cut_lineage

SPAN, REACH, GRAM = 400, 180, 32
PLACES = 30  # bits of a place within a slice
FOLDED = 100_000  # repeated surroundings a task remembers
MOST = 50_000  # occurrences of a phrase that one task compares; beyond, each string is a row of its own
U = np.uint64


def triggers(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per trigger: text, first and last start that fall to it, fingerprints of its phrase and of all their strings together."""
    counts = np.maximum(np.diff(off) - SPAN + 1, 0)
    start = spread(off[:-1], counts)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    roll = Rolling(body)
    grams = roll.every(GRAM)
    m = len(grams)
    key = (grams >> U(PLACES) << U(PLACES)) | (U((1 << PLACES) - 1) - np.arange(m, dtype=U))
    rows = -(-m // REACH) + 1
    full = np.full(rows * REACH, np.iinfo(U).max, U)
    full[:m] = key
    full = full.reshape(rows, REACH)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[start], ahead[start + REACH - 1])
    at = ((1 << PLACES) - 1) - (least & U((1 << PLACES) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    lo, hi, place = start[first], start[np.r_[first[1:] - 1, len(start) - 1]], at[first]
    phrase = roll.of(place, place + SPAN - REACH + 1)
    around = mix(roll.of(lo, hi + SPAN) + (place - lo).astype(U))
    return np.searchsorted(off, lo, "right") - 1, lo, hi, phrase, around


def parse(docs: DataFrame) -> DataFrame:
    """(doc, lo, n, phrase, around, state) per trigger; state 2 is known as repeated, 1 stands for such, 0 is to be compared."""

    def run(batches):
        seen = np.zeros(0, U)
        for batch in batches:
            for part in slices(batch, "_text"):
                body, off = flat_bytes(part.column("_text"))
                text, lo, hi, phrase, around = triggers(body, off)
                if not len(text):
                    continue
                values, first, which, n = np.unique(around, return_index=True, return_inverse=True, return_counts=True)
                old = np.isin(values, seen)
                many = n > 1
                state = np.where(old | many, 2, 0)[which]
                lead = np.flatnonzero(many & ~old)
                if len(lead):
                    seen = values[lead] if len(seen) + len(lead) > FOLDED else np.concatenate([seen, values[lead]])
                uid = part.column("_doc").to_numpy()[text]
                rel = lo - off[text]
                pick = np.r_[np.arange(len(text)), first[lead]]
                state = np.r_[state, np.ones(len(lead), np.int64)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid[pick]), pa.array(rel[pick]), pa.array((hi - lo + 1)[pick].astype(np.int32)), pa.array(phrase[pick].view(np.int64)),
                    pa.array(around[pick].view(np.int64)), pa.array(state.astype(np.int32))], names=["doc", "lo", "n", "phrase", "around", "state"])

    return docs.mapInArrow(run, "doc long, lo long, n int, phrase long, around long, state int")


NAMES = ("doc", "lo", "n", "phrase", "around", "state")


def compare(rows: DataFrame) -> DataFrame:
    """Sorted parse rows in, (doc, lo, n, phrase, kind) out: kind 2 repeated starts, 0 and 1 to be compared string by string.

    Only neighbours in the order are looked at, so a task holds one batch whatever a phrase's number of rows.
    """

    def run(batches):
        held, before, pred = None, None, False  # the last row, the one before it, and whether its surroundings have others of the phrase before them
        def judge(cols, after):
            nonlocal before, pred
            doc, lo, n, phrase, around, state = cols
            prev_p, prev_a = np.r_[before[0] if before else 0, phrase[:-1]], np.r_[before[1] if before else 0, around[:-1]]
            next_p, next_a = np.r_[phrase[1:], after[0] if after else 0], np.r_[around[1:], after[1] if after else 0]
            has_prev, has_next = np.ones(len(doc), bool), np.ones(len(doc), bool)
            has_prev[0], has_next[-1] = before is not None, after is not None
            same_p_prev, same_p_next = has_prev & (prev_p == phrase), has_next & (next_p == phrase)
            same_prev, same_next = same_p_prev & (prev_a == around), same_p_next & (next_a == around)
            head = np.maximum.accumulate(np.where(same_prev, -1, np.arange(len(doc))))
            led = np.where(head >= 0, same_p_prev[np.maximum(head, 0)], pred)
            before, pred = (phrase[-1], around[-1]), bool(led[-1])
            repeated = (same_prev | same_next) & (state == 0)
            mixed = ~same_next & (led | same_p_next)
            kind = (same_prev | (state == 1)).astype(np.int32)
            for keep, k in ((repeated, np.full(len(doc), 2, np.int32)), (mixed, kind)):
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, lo, n, phrase, k)], names=["doc", "lo", "n", "phrase", "kind"])

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in NAMES]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.r_[h, c] for h, c in zip(held, cols)]
            held = [c[-1:] for c in cols]
            if len(cols[0]) > 1:
                yield from judge([c[:-1] for c in cols], (held[3][0], held[4][0]))
        if held is not None:
            yield from judge(held, None)

    return rows.mapInArrow(run, "doc long, lo long, n int, phrase long, kind int")


def string_prints(joined: DataFrame) -> DataFrame:
    """(phrase, doc, lo, kind, prints): the fingerprints of the strings at lo, lo + 1, ... of each listed trigger."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                body, off = flat_bytes(part.column("_text"))
                every = Rolling(body).every(SPAN).view(np.int64)
                out = []
                for base, doc, listed in zip(off.tolist(), part.column("_doc").to_pylist(), part.column("places").to_pylist()):
                    out += [(x["phrase"], doc, x["lo"], x["kind"], every[base + x["lo"]: base + x["lo"] + x["n"]]) for x in listed]
                if out:
                    phrase, doc, lo, kind, prints = zip(*out)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in prints])].astype(np.int32)), pa.array(np.concatenate(prints)))
                    yield pa.RecordBatch.from_arrays([pa.array(phrase), pa.array(doc), pa.array(lo), pa.array(kind, pa.int32()), lists], names=["phrase", "doc", "lo", "kind", "prints"])

    return joined.mapInArrow(run, "phrase long, doc long, lo long, kind int, prints array<long>")


def equal_strings(rows: DataFrame) -> DataFrame:
    """(doc, lo, n): runs of starts whose string another row of the phrase has too; rows come sorted by phrase."""

    def one(doc, lo, kind, prints):
        n = np.array([len(p) for p in prints])
        flat = np.concatenate(prints)
        _, which, count = np.unique(flat, return_inverse=True, return_counts=True)
        hit = count[which] > 1
        ends = np.cumsum(n)
        out = ([], [], [])
        for d, at, k, e, size in zip(doc, lo, kind, ends.tolist(), n.tolist()):
            if k == 0:
                own = np.flatnonzero(np.diff(np.r_[0, hit[e - size: e].astype(np.int8), 0]))
                for a, b in zip(own[::2].tolist(), own[1::2].tolist()):
                    out[0].append(d)
                    out[1].append(at + a)
                    out[2].append(b - a)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["doc", "lo", "n"])

    def run(batches):
        phrase, own = None, ([], [], [], [])
        for batch in batches:
            lists = batch.column("prints")
            flat, off = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            rows = zip(*(batch.column(c).to_pylist() for c in ("phrase", "doc", "lo", "kind")))
            for i, (p, d, at, k) in enumerate(rows):
                if p != phrase:
                    if own[0]:
                        yield one(*own)
                    phrase, own = p, ([], [], [], [])
                for c, x in zip(own, (d, at, k, flat[off[i]: off[i + 1]])):
                    c.append(x)
        if own[0]:
            yield one(*own)

    return rows.mapInArrow(run, "doc long, lo long, n int")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc, lo, n): all starts of strings of SPAN bytes that occur again, as runs; ``docs`` has _doc and _text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Which of equal rows is the one to be compared hangs on the order of a task's input, so the parse is made once.
    rows = cut_lineage(parse(docs))
    compared = cut_lineage(compare(rows.where("state < 2").repartition(parts, "phrase").sortWithinPartitions("phrase", "around")))
    known = rows.where("state = 2").select("doc", "lo", "n").unionAll(compared.where("kind = 2").select("doc", "lo", "n"))
    open_ = compared.where("kind < 2")
    places = open_.groupBy(F.col("doc").alias("_d")).agg(F.collect_set(F.struct("phrase", "lo", "n", "kind")).alias("places"))
    joined = docs.join(places, F.col("_doc") == F.col("_d")).dropDuplicates(["_doc"]).select("_doc", "_text", "places")
    hot = open_.groupBy(F.col("phrase").alias("_p")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > MOST)
    prints = cut_lineage(string_prints(joined))
    several = prints.join(hot, F.col("phrase") == F.col("_p"), "left_anti")
    some = equal_strings(several.repartition(parts, "phrase").sortWithinPartitions("phrase"))
    each = prints.join(hot, F.col("phrase") == F.col("_p"), "left_semi").select("doc", "lo", "kind", F.posexplode("prints").alias("i", "print"))
    twice = each.groupBy(F.col("print").alias("_w")).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    more = each.where("kind = 0").join(twice, F.col("print") == F.col("_w"), "left_semi").select("doc", (F.col("lo") + F.col("i")).alias("lo"), F.lit(1).alias("n"))
    return known.unionAll(some).unionAll(more)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256), one row per input row, and the rest as binary ``kept`` on request."""
    docs = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs = docs.withColumn("_doc", F.xxhash64("_key", "_text"))
    runs = repeated_starts(docs.select("_doc", "_text"))
    per_doc = runs.groupBy(F.col("doc").alias("_d")).agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    joined = docs.join(per_doc, F.col("_doc") == F.col("_d"), "left").select("_key", "_text", "runs")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                body, off = flat_bytes(part.column("_text"))
                out = ([], [], [], [], [])
                lists = part.column("runs")
                los, ns = lists.flatten().field("lo").to_numpy(), lists.flatten().field("n").to_numpy()
                sizes = np.array(lists.fill_null([]).value_lengths()) if lists.null_count else lists.value_lengths().to_numpy()
                at = 0
                for d, size in enumerate(sizes.tolist()):
                    own = body[off[d]: off[d + 1]]
                    spans = gone = 0
                    if size:
                        step = np.zeros(len(own) + 1, np.int64)
                        np.add.at(step, los[at: at + size], 1)
                        np.add.at(step, los[at: at + size] + ns[at: at + size] - 1 + SPAN, -1)
                        at += size
                        cut = np.cumsum(step)[:-1] > 0
                        gone = int(cut.sum())
                        spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                        kept = own[~cut].tobytes()
                    else:
                        kept = own.tobytes()
                    for c, x in zip(out, (len(own), gone, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)):
                        c.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_key"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                                 names=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"_key {docs.schema['_key'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = joined.mapInArrow(run, schema).withColumnRenamed("_key", key)
    return out if keep_text else out.drop("kept")
