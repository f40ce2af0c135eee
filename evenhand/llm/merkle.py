"""Operator 13: a Merkle manifest of a dataset by checkpoint and recompute.

Leaves are hashes of rows, in order within their group (language). Of the tree above them only every ``LEVELS``-th level is
stored. A proof goes down from the root: each aligned subtree between two stored levels is built again from its stored
descendants in the task that needs it, gives every one of them its siblings inside, and is dropped.

A row whose key is null comes before the others of its group and is never tampered with; rows of one key follow their leaf. Null and
empty values give different leaves. Repeated rows are leaves of their own. An empty table has no rows in its manifest.
A proof is an array of steps from the leaf to the root: ``<`` and the sibling on the left, ``>`` and the one on the right, ``.`` for a node alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.hot import numbered
from evenhand.operators.core import row_numbers
from evenhand.session import cut_lineage

LEVELS = 10  # between two stored levels; a subtree has at most 2 ** LEVELS stored descendants
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def leaf_hash(fields: Sequence[str], **changed: Column) -> Column:
    """Hash of the fields, each as its length in bytes and its value, or ``-`` for null."""
    value = lambda c: changed.get(c, F.col(c)).cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in fields]), 256)


def parents(nodes: list[str]) -> list[str]:
    out = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(nodes[::2], nodes[1::2])]
    return out + [hashlib.sha256(nodes[-1].encode()).hexdigest()] if len(nodes) % 2 else out


def subtree(nodes: list[str], height: int) -> tuple[str, list[list[str]]]:
    """Top node of an aligned subtree and, per stored descendant, its steps to that node."""
    steps: list[list[str]] = [[] for _ in nodes]
    for level in range(height):
        for i, own in enumerate(steps):
            at = i >> level
            own.append("<" + nodes[at - 1] if at % 2 else ">" + nodes[at + 1] if at + 1 < len(nodes) else ".")
        nodes = parents(nodes)
    return nodes[0], steps


def height(n: int, level: int, most: int) -> int:
    """Levels of a subtree above stored level ``level`` in a group of ``n`` leaves."""
    return max(0, min(most, depth(n) - level))


def depth(n: int) -> int:
    return max(n - 1, 0).bit_length()


def lift(level: int, most: int):
    """The top node of an aligned subtree above stored level ``level``."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        g, n, at = (group.column(c)[0].as_py() for c in ("g", "n", "at"))
        node = group.column("node").to_pylist()
        for _ in range(height(n, level, most)):
            node = parents(node)
        return pa.table({"g": [g], "n": [n], "at": [at >> most], "node": node})

    return run


def extract(level: int, most: int):
    """The stored descendants of an aligned subtree with their steps, continued by those of its top node."""

    def run(group: pa.Table, upper: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        rest = upper.column("steps")[0].as_py()
        _, steps = subtree(group.column("node").to_pylist(), height(group.column("n")[0].as_py(), level, most))
        return group.append_column("steps", pa.array([own + rest for own in steps], pa.list_(pa.string())))

    return run


class Forest:
    """Stored levels of the trees of all groups: frames (g, n, at, node), n being the leaves of the group."""

    def __init__(self, leaves: DataFrame):
        self.stored = [leaves]
        for level in range(0, max(depth(leaves.agg(F.max("n")).first()[0] or 0), 1), LEVELS):
            blocks = self.stored[-1].select("g", "n", "at", "node").groupBy("g", block("at").alias("_block"))
            self.stored.append(cut_lineage(blocks.applyInArrow(lift(level, LEVELS), "g string, n long, at long, node string")))

    def roots(self) -> DataFrame:
        """(g, n, node): the last node of every group."""
        return self.stored[-1].select("g", "n", "node")

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """The leaves with ``steps`` to the root of their group, continued by those of ``above`` (g, steps)."""
        top = self.stored[-1].select("g", "at")
        paths = top.withColumn("steps", F.array().cast("array<string>")) if above is None else top.join(above, "g")
        for i in reversed(range(len(self.stored) - 1)):
            below = self.stored[i]
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in below.schema) + ", steps array<string>"
            pairs = below.groupBy("g", block("at").alias("_block")).cogroup(paths.groupBy("g", F.col("at").alias("_block")))
            paths = pairs.applyInArrow(extract(LEVELS * i, LEVELS), kinds)
            if i:
                paths = cut_lineage(paths.select("g", "at", "steps"))
        return paths


def block(at: str) -> Column:
    return F.shiftright(at, LEVELS)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    own = lambda s: F.substring(s, 2, 64)
    side = lambda s: F.substring(s, 1, 1)
    joined = lambda node, s: F.when(side(s) == "<", F.concat(own(s), node)).when(side(s) == ">", F.concat(node, own(s))).otherwise(node)
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(joined(node, s), 256))


def proof_digest(steps: Column) -> Column:
    """Hash of the siblings of a proof from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.substring(s, 2, 64)), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None,
             when: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, steps, found), one row per row of ``docs``.

    ``found`` is the leaf of the row as it is checked later: where ``when`` holds, the columns in ``tampered`` have changed.
    """
    found = F.when(F.coalesce(when, F.lit(False)), leaf_hash(fields, **tampered)) if tampered else F.lit(None).cast("string")
    # null first, then by bytes: every named group starts with a character of its own
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = numbered(docs.select(F.col(key).alias("_key"), g.alias("g"), leaf_hash(fields).alias("node"), found.alias("found")))
    placed = row_numbers(leaves, ["g"], "_key", ties=["node", "_row"], out="_place", total="n")
    placed = cut_lineage(placed.select("g", "n", (F.col("_place") - 1).alias("at"), "node", "_key", "found"))
    trees = Forest(placed)
    subroots = row_numbers(trees.roots().select(F.col("g").alias("h"), "node"), [], "h", out="_place", total="n")
    crown = Forest(cut_lineage(subroots.select(F.lit("").alias("g"), "n", (F.col("_place") - 1).alias("at"), "node", "h")))
    root = crown.roots().select("node").scalar()
    above = cut_lineage(crown.proofs().select(F.col("h").alias("g"), "steps", F.col("node").alias("subroot")))
    proofs = trees.proofs(above.select("g", F.concat("steps", F.array("subroot")).alias("steps")))
    steps = F.slice("steps", 1, F.size("steps") - 1)
    return proofs.select(F.col("_key").alias(key), F.col("node").alias("leaf"), F.element_at("steps", -1).alias("subroot"),
                         root.alias("root"), steps.alias("steps"), "found")


def tamper_check(docs: DataFrame, key: str = "doc_id", field: str = "n_chars") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): ``field`` grows by 1 where 7 divides the crc32 of the key."""
    rows = manifest(docs, key=key, tampered={field: F.col(field) + 1}, when=F.crc32(F.col(key).cast("string").cast("binary")) % TAMPERED == 0)
    out = rows.withColumn("folded_root", fold(F.coalesce("found", "leaf"), F.col("steps")))
    return out.select(key, "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
