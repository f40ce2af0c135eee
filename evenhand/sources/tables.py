"""Readers and writers. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.functions import expr as E
from evenhand.operators.core import same_keys
from evenhand.session import cut_lineage, scratch_path
from evenhand.sources import digest

PIECE = 1 << 27  # bytes of a file that one task digests


def read_table_csv(spark: SparkSession, path: str, strings: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Headered CSV: ids stay text, numbers are coerced and a bad value becomes NULL."""
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in [*strings, *numbers])).option(
        "enforceSchema", False).csv(path)
    return raw.select(*strings, *[E.finite(E.to_number(c)).alias(c) for c in numbers])


def read_json_listing(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Flat objects, one per line (``multi_line`` for files that hold one array)."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_entity_records(spark: SparkSession, path: str, schema: str, columns: dict[str, str], multi_line: bool = False) -> DataFrame:
    """One nested record per entity, flattened by ``columns`` (output name to path), with the source file name.

    Records stand one per line, or with ``multi_line`` one per file, indented as they may be. A file that holds no record
    fails the query.
    """
    rec = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    return rec.select(*[F.col(p).alias(n) for n, p in columns.items()],
                      F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"))


def records_to_long(df: DataFrame, key: str, names: str, values: str) -> DataFrame:
    """Parallel name and value arrays to (key, feature, value)."""
    return df.select(key, F.explode(F.arrays_zip(F.col(names).alias("n"), F.col(values).alias("v"))).alias("z")).select(
        key, F.col("z.n").alias("feature"), F.col("z.v").cast("double").alias("value"))


def records_to_matrix(df: DataFrame, key: str, names: str, values: str, features: Sequence[str]) -> DataFrame:
    """Wide matrix with the declared features; no shuffle, the arrays are indexed by name."""
    m = F.map_from_arrays(F.col(names), F.col(values))
    return df.select(key, *[F.try_element_at(m, F.lit(f)).cast("double").alias(f) for f in features])


def read_bags(df: DataFrame, width: int, key: str = "key", inst: str = "inst", features: str = "features") -> DataFrame:
    """Instances with a verdict: ok, wrong_width or nonfinite."""
    bad = F.exists(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(key, inst, features, E.first_rule(
        [("wrong_width", F.col(features).isNull() | (F.size(features) != width)), ("nonfinite", bad)], "ok").alias("verdict"))


def read_box_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``<object>``: name and the four corners."""
    box = T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")])
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("bndbox", box)])
    raw = spark.read.format("xml").option("rowTag", "object").schema(schema).load(path)
    return raw.select("name", F.col("bndbox.xmin").alias("x0"), F.col("bndbox.ymin").alias("y0"),
                      F.col("bndbox.xmax").alias("x1"), F.col("bndbox.ymax").alias("y1"))


def sql_select(df: DataFrame, view: str, columns: Sequence[str], predicate: str) -> DataFrame:
    """``SELECT columns FROM view WHERE predicate`` over a frame."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(f"SELECT {', '.join(columns)} FROM {view} WHERE {predicate}")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids from text lines; ``#`` starts a comment, blank lines are skipped."""
    line = F.trim(F.split("value", "#").getItem(0))
    return spark.read.text(path).select(line.alias("id")).where(F.col("id") != "")


def file_digests(spark: SparkSession, path: str, glob: str = "*", piece: int = PIECE) -> DataFrame:
    """SHA-256 and size per file; no task holds or reads more than about ``piece`` bytes of a file, or one line of it.

    The bytes are read as lines, which Spark splits, and stored in chunks. The digest of a file is a chain, so one round follows
    another: a task takes the chunks of one piece and goes on from the state that the round before has left. Spark's readers
    leave out empty files.
    """
    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    at = F.col("_metadata.file_path")
    files = read.format("binaryFile").load(path).select(at.alias("at"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    if not digest.RESUMABLE:
        whole = read.format("binaryFile").load(path)
        return whole.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    packed = at.rlike(digest.PACKED)  # what Spark would unpack is read whole
    lines = read.option("lineSep", "\n").text(path).where(~packed)
    chunks = scratch_path(spark, "chunks")
    start = F.col("_metadata.file_block_start")
    digest.chunks(lines.select(F.xxhash64(at).alias("id"), start.alias("start"), F.col("value").cast("binary").alias("line"))).withColumn(
        "piece", F.floor(F.col("start") / piece).cast("int")).write.partitionBy("piece").parquet(chunks)
    chunks = spark.read.schema(f"{digest.CHUNK}, piece int").parquet(chunks)
    sizes = chunks.groupBy("id").agg(F.sum("size").alias("total"), F.max("piece").alias("last"))
    todo = files.where(~F.col("at").rlike(digest.PACKED)).withColumn("id", F.xxhash64("at"))
    todo = cut_lineage(todo.join(sizes.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").drop("_i"))
    state = todo.select("id", F.lit(None).cast("binary").alias("state"), F.lit(0).cast("long").alias("done"), "total", "bytes", F.coalesce("last", F.lit(0)).alias("last"))
    ready = []
    for k in range((todo.agg(F.max("last")).first()[0] or 0) + 1):
        state = cut_lineage(digest.advance(state, chunks.where(F.col("piece") == k).drop("piece")))
        ready.append(state.where(F.col("last") == k).select(F.col("id").alias("_i"), "sha256"))
        state = state.where(F.col("last") > k).drop("sha256")
    known = todo.join(reduce(DataFrame.unionAll, ready), F.col("id") == F.col("_i")).select("file", "bytes", "sha256")
    whole = read.format("binaryFile").load(path).where(packed)
    return known.unionAll(whole.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", by: Sequence[str] = ()) -> str:
    """Result table; the commit protocol makes the job's files appear together."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if by:
        w = w.partitionBy(*by)
    w.save(path)
    return path


def line_manifest(df: DataFrame, fmt: str, cols: Sequence[str]) -> DataFrame:
    """One formatted line per row, ready for ``write.text``."""
    return df.select(F.format_string(fmt, *[F.col(c) for c in cols]).alias("value"))


def pending(todo: DataFrame, done: DataFrame, key: str, status: str = "status", ok: str = "ok") -> DataFrame:
    """Rows of ``todo`` not yet finished."""
    return todo.join(done.where(F.col(status) == ok).select(key), key, "left_anti")


def incremental_append(prev: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Earlier rows plus new ones; a new row replaces the earlier row of the same key."""
    return prev.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def assemble_manifest(cohort: DataFrame, records: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Cohort left-joined to each named record table; columns take the record's name as prefix."""
    out = cohort
    for name, rec in records:
        out = same_keys(out, rec.select(key, *[F.col(c).alias(f"{name}_{c}") for c in rec.columns if c != key],
                                        F.lit(True).alias(f"has_{name}")), [key], "left")
        out = out.withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out
