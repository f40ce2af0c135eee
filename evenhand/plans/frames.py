"""Canonical frames derived from the given tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators import splits


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark, sf) -> DataFrame:
    """key, site, y, score: labelled documents, the language as site."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("site"),
                                             F.col("n_chars").cast("double").alias("score"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("y"))
    return d.join(lab, "key").select("key", "site", "y", "score")


def obs_pair(spark, sf) -> DataFrame:
    """key, site, y, pa, pb: two scores per labelled document (length, mean word length)."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("key"), F.col("lang").alias("site"), F.col("n_chars").cast("double").alias("pa"),
        (F.col("n_chars") / F.size(F.split("text", " "))).alias("pb"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("y"))
    return d.join(lab, "key").select("key", "site", "y", "pa", "pb")


def prob_pair(spark, sf) -> DataFrame:
    """obs_pair with both scores turned into probabilities."""
    d = obs_pair(spark, sf)
    return d.withColumn("pa", E.sigmoid((F.col("pa") - 1000) / 1000)).withColumn("pb", E.sigmoid(F.col("pb") - 6))


def wide_emb(spark, sf) -> DataFrame:
    """key, site, y, features: one vector per row."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"), F.concat(F.lit("S"), F.col("label") % 4).alias("site"),
        (F.col("label") >= 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("features"))


def long_emb(spark, sf) -> DataFrame:
    """key, site, y, feature, value."""
    return wide_emb(spark, sf).select("key", "site", "y", F.posexplode("features").alias("feature", "value"))


def long_missing(spark, sf) -> DataFrame:
    """long_emb in which readings beyond the instrument range are missing."""
    return long_emb(spark, sf).withColumn("value", F.when(F.abs("value") <= 0.25, F.col("value")))


def obs_emb(spark, sf) -> DataFrame:
    return wide_emb(spark, sf).select("key", "site", "y")


def emb_split(spark, sf, k: int = 3, seed: int = 7) -> DataFrame:
    """fold, key, role over the embedding rows."""
    return splits.stratified_kfold(obs_emb(spark, sf), "key", ["site", "y"], k, seed)


def long_folds(spark, sf) -> DataFrame:
    """long_emb repeated per fold with its role."""
    return emb_split(spark, sf).join(long_emb(spark, sf), "key")


def bags(spark, sf) -> DataFrame:
    """bag, inst, weight, ts: events per user, the weights of a bag summing to one."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("bag"), F.col("event_id").alias("inst"), "ts",
                                           "event_type", "value")
    tot = ev.groupBy("bag").agg(F.sum("value").alias("_t"))
    return ev.join(tot, "bag").withColumn("weight", F.col("value") / F.col("_t")).drop("_t")


def long_bag(spark, sf) -> DataFrame:
    """bag, inst, site, y, feature, value: every vector an instance of the bag of its class label."""
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("bag"), F.col("vec_id").alias("inst"),
        F.concat(F.lit("S"), F.col("label") % 4).alias("site"), (F.col("label") >= 5).cast("int").alias("y"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "value"))


def series(spark, sf) -> DataFrame:
    """patient, study, series, modality, bytes, images, maker, study_date, description, site, licence."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                             "l_extendedprice", "l_returnflag", "l_linestatus")
    od = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    cu = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return (li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(cu, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("study"),
                    F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"),
                    F.col("l_returnflag").alias("modality"), F.col("l_linestatus").alias("maker"),
                    F.round("l_extendedprice").cast("bigint").alias("bytes"),
                    F.col("l_quantity").cast("int").alias("images"),
                    F.date_format("o_orderdate", "yyyyMMdd").alias("study_date"),
                    F.col("o_orderpriority").alias("description"), F.col("o_orderstatus").alias("licence"),
                    F.col("c_mktsegment").alias("collection"), F.col("c_nationkey").alias("nation")))


def cells(spark, sf) -> DataFrame:
    """case, z, y, x, value, mask: line items laid out on a grid, one grid per supplier."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("case"), F.col("l_linenumber").alias("z"),
                     F.col("l_quantity").cast("int").alias("y"), F.floor(F.col("l_partkey") / 40).cast("int").alias("x"),
                     F.col("l_extendedprice").alias("value"), (F.col("l_returnflag") != "N").alias("mask"),
                     (F.col("l_linestatus") == "F").alias("region"), F.round(F.col("l_discount") * 150).alias("dist"))


def grid(spark, sf) -> DataFrame:
    """cells with one row per position."""
    return cells(spark, sf).groupBy("case", "z", "y", "x").agg(
        F.max("value").alias("value"), F.bool_or("mask").alias("mask"), F.bool_or("region").alias("region"), F.max("dist").alias("dist"))


# The same frames for the SQL side.
CTE = {
    "obs": "SELECT d.doc_id AS key, d.lang AS site, l.quality::INT AS y, d.n_chars::DOUBLE AS score "
           "FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "obs_pair": "SELECT d.doc_id AS key, d.lang AS site, l.quality::INT AS y, d.n_chars::DOUBLE AS pa, "
                "d.n_chars::DOUBLE / len(string_split(d.text, ' ')) AS pb "
                "FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "prob_pair": "SELECT key, site, y, 1/(1+exp(-(pa-1000)/1000)) AS pa, 1/(1+exp(-(pb-6))) AS pb FROM obs_pair",
    "long_emb": "SELECT vec_id AS key, 'S' || (label % 4) AS site, (label >= 5)::INT AS y, t.f::INT AS feature, "
                "embedding[t.f + 1]::DOUBLE AS value FROM embeddings, range(64) t(f)",
    "long_missing": "SELECT key, site, y, feature, CASE WHEN abs(value) <= 0.25 THEN value END AS value FROM long_emb",
    "obs_emb": "SELECT vec_id AS key, 'S' || (label % 4) AS site, (label >= 5)::INT AS y FROM embeddings",
    "emb_rank": "SELECT key, site, y, (row_number() OVER (PARTITION BY site, y ORDER BY "
                "('0x' || substr(md5('7|' || key), 1, 15))::BIGINT, key) - 1) % 3 AS test_fold FROM obs_emb",
    "emb_split": "SELECT t.fold::INT AS fold, key, site, y, CASE WHEN test_fold = t.fold THEN 'test' ELSE 'train' END AS role "
                 "FROM emb_rank, range(3) t(fold)",
    "long_folds": "SELECT s.fold, s.role, l.* FROM emb_split s JOIN long_emb l ON s.key = l.key",
    "bags": "SELECT user_id AS bag, event_id AS inst, ts, event_type, value, "
            "value / sum(value) OVER (PARTITION BY user_id) AS weight FROM events",
    "long_bag": "SELECT label AS bag, vec_id AS inst, 'S' || (label % 4) AS site, (label >= 5)::INT AS y, "
                "t.f::INT AS feature, embedding[t.f + 1]::DOUBLE AS value FROM embeddings, range(64) t(f)",
    "series": "SELECT o_custkey AS patient, o_orderkey AS study, l_partkey AS part, l_linenumber AS line, "
              "l_returnflag AS modality, l_linestatus AS maker, round(l_extendedprice)::BIGINT AS bytes, "
              "l_quantity::INT AS images, strftime(o_orderdate, '%Y%m%d') AS study_date, "
              "o_orderpriority AS description, o_orderstatus AS licence, c_mktsegment AS collection, "
              "c_nationkey AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
              "JOIN customer ON o_custkey = c_custkey",
    "cells": "SELECT l_suppkey AS \"case\", l_linenumber AS z, l_quantity::INT AS y, floor(l_partkey / 40)::INT AS x, "
             "l_extendedprice AS value, l_returnflag <> 'N' AS mask, l_linestatus = 'F' AS region, "
             "round(l_discount * 150) AS dist FROM lineitem",
    "grid": 'SELECT "case", z, y, x, max(value) AS value, bool_or(mask) AS mask, bool_or(region) AS region, max(dist) AS dist '
            "FROM cells GROUP BY ALL",
}
CTE_NEEDS = {"grid": ("cells",), "prob_pair": ("obs_pair",), "long_missing": ("long_emb",), "emb_rank": ("obs_emb",), "emb_split": ("emb_rank",),
             "long_folds": ("emb_split", "long_emb")}
