"""Operator 9: a sparse rule ensemble over text statistics.

Shallow trees are fitted on labelled rows; every path from a root to a node is a conjunctive rule over the statistics.
A lasso logistic fit keeps few rules, and those become one Spark column expression that scores any table of statistics.

The fit uses at most SAMPLE labelled rows, the ones with the smallest hash of their id; everything else runs over all
rows. Null and empty texts have statistics of zero and a score as any text. Without labels of both kinds every score is
the share of good labels, or 0.5 without labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import Rolling, flat_bytes, slices
from evenhand.session import cut_lineage

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
STATISTICS = ("words", "mean_word", "upper", "digits", "symbols", "pipes", "bangs", "commas", "stops", "repeated", "distinct", "line_words", "wide")


def statistics(body: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each text of a slice, in float64."""
    docs = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(np.float64)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag, dtype=np.int64)]
        return (total[off[1:]] - total[off[:-1]]).astype(np.float64)

    solid = body > 32
    first = np.zeros(len(body), bool)  # of a document
    first[off[:-1][np.diff(off) > 0]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(off, start, "right") - 1
    words = np.bincount(owner, minlength=docs).astype(np.float64)
    some = np.maximum(words, 1)
    code = Rolling(body).of(start, stop)
    same = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    keyed = np.sort(owner.astype(np.uint64) << np.uint64(40) | code >> np.uint64(24))
    fresh = np.r_[True, keyed[1:] != keyed[:-1]] if len(keyed) else np.zeros(0, bool)
    distinct = np.bincount((keyed[fresh] >> np.uint64(40)).astype(np.int64), minlength=docs)
    capital = (body >= 65) & (body < 91)
    accented = np.zeros(len(body), bool)  # capital letters of two bytes
    accented[1:] = (body[:-1] == 0xC3) & (body[1:] < 0x9F)
    letters = share(capital | ((body >= 97) & (body < 123)) | (body == 0xC3))
    mark = ((body > 32) & (body < 48) | (body > 57) & (body < 65) | (body > 90) & (body < 97) | (body > 122) & (body < 127))
    plain = (body == 44) | (body == 46) | (body == 39) | (body == 45)
    return {
        "words": words, "mean_word": share(solid) / some, "upper": share(capital | accented) / np.maximum(letters, 1),
        "digits": share((body >= 48) & (body < 58)) / size, "symbols": share(mark & ~plain) / size, "pipes": share(body == 124) / some,
        "bangs": share(body == 33) / some, "commas": share(body == 44) / some, "stops": share(body == 46) / some,
        "repeated": np.bincount(owner[1:][same], minlength=docs) / some, "distinct": distinct / some,
        "line_words": words / (share(body == 10) + 1), "wide": share(body > 127) / size,
    }


def with_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and, under names that start with ``stat_``, the statistics of ``text``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                made = statistics(*flat_bytes(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(made[s], pa.float64()) for s in STATISTICS]],
                                                 names=[*names, *[f"stat_{s}" for s in STATISTICS]])

    names = [f"_keep{i}" for i in range(len(keep))]
    src = df.select(F.col(text).alias("_text"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    schema = ", ".join([f"{n} {src.schema[n].dataType.simpleString()}" for n in names] + [f"stat_{s} double" for s in STATISTICS])
    return src.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep)))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of them


def tree_rules(model) -> list[Rule]:
    """The distinct paths of a fitted forest."""
    found: dict[Rule, None] = {}

    def walk(node, path):
        if path:
            found.setdefault(tuple(sorted(path)))
        if node.subtreeDepth():
            at, cut = node.split().featureIndex(), node.split().threshold()
            walk(node.leftChild(), [*path, (at, False, cut)])
            walk(node.rightChild(), [*path, (at, True, cut)])

    for tree in model.trees:
        walk(tree._call_java("rootNode"), [])
    return list(found)


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for at, above, cut in rule:
        value = F.col(f"stat_{STATISTICS[at]}")
        out &= value > cut if above else value <= cut
    return out


def score_column(rules: list[Rule], weights: list[float], intercept: float) -> Column:
    total = F.lit(float(intercept))
    for rule, weight in zip(rules, weights):
        total = total + F.when(rule_column(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE, trees: int = 20, depth: int = 3, penalty: float = 0.0002) -> tuple[list[Rule], list[float], float]:
    """Rules, weights and intercept from labelled rows outside the held-out part."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("double").alias("_y"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(sample).select(F.col(key).alias("_id"), "_y")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_doc"))
    joined = texts.join(F.broadcast(chosen), F.col("_key") == F.col("_id"))  # at most ``sample`` ids
    rows = cut_lineage(with_statistics(joined, "_doc", ("_y",)))
    n, mean = rows.agg(F.count("_y"), F.avg("_y")).first()
    if not n or mean in (0.0, 1.0):
        p = min(max(mean if n else 0.5, 1e-6), 1 - 1e-6)
        return [], [], float(np.log(p / (1 - p)))
    rows = rows.coalesce(4)
    stats = VectorAssembler(inputCols=[f"stat_{s}" for s in STATISTICS], outputCol="features")
    forest = RandomForestClassifier(labelCol="_y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=7)
    rules = tree_rules(forest.fit(stats.transform(rows)))
    if not rules:
        return [], [], float(np.log(mean / (1 - mean)))
    marks = rows.select("_y", *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    marks = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(marks).select("_y", "features")
    lasso = LogisticRegression(labelCol="_y", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60)
    model = lasso.fit(cut_lineage(marks))
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w]
    return [r for r, _ in kept], [w for _, w in kept], float(model.intercept)


def score(docs: DataFrame, fitted: tuple[list[Rule], list[float], float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted), one row per input row."""
    scored = with_statistics(docs, text, (key,)).select(key, held_out(key).alias("held_out"), score_column(*fitted).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, fitted: tuple[list[Rule], list[float], float], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules accept, with all their columns."""
    names = docs.columns
    safe = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    scored = with_statistics(safe.withColumn("_text0", F.col(f"_c{names.index(text)}")), "_text0", tuple(safe.columns))
    kept = scored.where(score_column(*fitted) >= THRESHOLD).select(*safe.columns)
    return kept.toDF(*names)
