"""Operator 3: benchmark decontamination by a broadcast set of benchmark word windows. DataFrame functions only.

Every distinct window of the benchmark is known by its rarest word, the anchor. One pass over the documents keeps, for
each anchor in a text, its place and the words around it; the windows of that anchor are then compared with those words.
Anchors go to the executors as literal sets of at most ANCHORS words; a larger benchmark is scanned in several blocks.

Null and empty texts have no words, no hits and are clean. Repeated rows each get their own result row. An empty
benchmark marks nothing; benchmark items without words have no window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.session import cut_lineage

WINDOW = 13
ANCHORS = 20_000
LONGEST = 3  # words of a window that may become its anchor
SHARE = 20  # contaminated: one word in so many is hit
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z alone) runs of ASCII letters, digits and characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP), "")


def benchmark_windows(bench: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(win, words, items): each distinct window, its words and the items it occurs in."""
    words = bench.select(F.col(item).alias("_item"), words_of(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(0)))
    each = words.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i + 1, n))).alias("words"))
    return each.groupBy(F.array_join("words", " ").alias("win")).agg(F.first("words").alias("words"), F.collect_set("_item").alias("items"))


def listed(values: list[str]) -> Column:
    """Whether a value is in the list; as text, which reaches the plan as one set of literals."""
    return lambda c: c.isin(values) if values else F.lit(False)


def anchored(windows: DataFrame, words: DataFrame, n: int = WINDOW) -> DataFrame:
    """``windows`` with their anchor, the rarest in ``words`` of their longest words, and the anchor's offset."""
    by_length = F.slice(F.array_sort("words", lambda a, b: F.length(b) - F.length(a)), 1, LONGEST)
    options = windows.select("win", F.explode(F.array_distinct(by_length)).alias("anchor"))
    some = options.select("anchor").distinct()
    blocks = max(1, -(-some.count() // ANCHORS))
    counts = []
    for b in range(blocks):
        own = [r[0] for r in some.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b).collect()]
        inside = listed(own)
        found = words.select(F.explode(F.filter("_w", lambda w: inside(w))).alias("anchor"))
        counts.append(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")))
    counted = options.join(reduce(DataFrame.unionAll, counts), "anchor", "left").fillna(0, ["_n"])
    best = counted.groupBy("win").agg(F.min_by("anchor", F.struct("_n", "anchor")).alias("anchor"))
    return windows.join(best, "win").withColumn("offset", (F.array_position("words", F.col("anchor")) - 1).cast("int")).withColumn("len", F.size("words"))


def union_length(spans: Column) -> Column:
    """How many places the half-open spans (s, e) cover, from an array of structs."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    add = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["reach"]))).cast("long").alias("n"),
        F.greatest(acc["reach"], x["e"]).cast("long").alias("reach"))
    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"])


def report(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           n: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, _hash): the benchmark windows in each document."""
    base = docs.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"), words_of(F.col(text)).alias("_w"))
    windows = cut_lineage(anchored(cut_lineage(benchmark_windows(bench, item, item_text, n)), base.select("_w"), n))
    total = windows.select("anchor").distinct().count()
    blocks = max(1, -(-total // ANCHORS))
    found, hits = None, []
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b)
        inside = listed([r[0] for r in part.select("anchor").distinct().collect()])
        places = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: inside(F.col("_w")[i]))
        around = lambda i: F.struct(i.cast("int").alias("p"), F.col("_w")[i].alias("anchor"), F.least(i, F.lit(n - 1)).cast("int").alias("before"),
                                    F.slice("_w", F.greatest(i - (n - 1), F.lit(0)) + 1, 2 * n - 1).alias("near"))
        places = F.when(F.size("_w") > 0, F.transform(places, around)).otherwise(F.array())
        seen = cut_lineage(base.select("_key", "_hash", F.size("_w").cast("long").alias("n_words"), places.alias("_at")))
        found = seen if found is None else found
        one = seen.select("_key", "_hash", F.explode("_at").alias("_x")).select("_key", "_hash", "_x.*")
        small = F.broadcast(part.select("anchor", "offset", "len", "win", "items"))  # of at most ANCHORS anchors
        both = one.join(small, "anchor").where((F.col("p") >= F.col("offset")) & (
            F.array_join(F.slice("near", F.col("before") - F.col("offset") + 1, F.col("len")), " ") == F.col("win")))
        hits.append(both.select("_key", "_hash", F.struct((F.col("p") - F.col("offset")).cast("long").alias("s"),
                                                          (F.col("p") - F.col("offset") + F.col("len")).cast("long").alias("e")).alias("span"), "items"))
    per_doc = reduce(DataFrame.unionAll, hits).groupBy("_key", "_hash").agg(
        F.collect_set("span").alias("_spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"))
    per_doc = per_doc.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), union_length(F.col("_spans")).alias("_n_hit"), "_items")
    out = found.join(per_doc, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    names = F.coalesce(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), F.array().cast("array<string>"))
    out = out.select(F.col("_key").alias(key), "n_words", F.coalesce("_n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                     F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "_hash")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = report(docs, bench, key, text, **options).where("contaminated").select(F.col(key).alias("_bad_key"), F.col("_hash").alias("_bad_hash")).distinct()
    same = docs[key].eqNullSafe(bad["_bad_key"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")
