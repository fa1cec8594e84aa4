"""Batches of files for analysis: groups of files that are no code, order, merging of small ones, changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import basename, utf16_order
from ..plans.loops import numbered
from .imports import directory

#: Files of a folder's batch; files below which a batch is merged; files of a merged one.
FOLDER, SMALL, MERGED = 20, 3, 25


def noncode_groups(files: DataFrame) -> DataFrame:
    """``path, family, grp, mergeable`` of files that are no code.

    In order: Dockerfiles with what lies beside them, by folder (A); workflows (B); other CI files (C); SQL migrations, by
    folder (D); all others by folder, FOLDER a group, in path order (E, the only groups that may be merged).
    """
    base, folder = basename(F.col("path")), directory(F.col("path"))
    docker = files.where(base == "Dockerfile").select(folder.alias("__dir"), F.lit(True).alias("__docker")).distinct()
    df = files.select("path", folder.alias("__dir"), base.alias("__base")).join(docker, "__dir", "left")
    beside = F.coalesce("__docker", F.lit(False)) & ((F.col("__base").isin("Dockerfile", ".dockerignore")) | F.col("__base").startswith("docker-compose."))
    family = (
        F.when(beside, "A")
        .when(F.col("path").rlike(r"^\.github/workflows/.*\.ya?ml$"), "B")
        .when((F.col("path") == ".gitlab-ci.yml") | F.col("path").startswith(".circleci/"), "C")
        .when(F.col("path").endswith(".sql") & F.col("__dir").rlike(r"(^|/)migrations?$"), "D")
        .otherwise("E")
    )
    marked = df.withColumn("family", family)
    rank = F.row_number().over(Window.partitionBy("family", "__dir").orderBy(utf16_order(F.col("path")))) - 1
    piece = F.when(F.col("family") == "E", F.floor(rank / FOLDER)).otherwise(0)
    name = F.when(F.col("family").isin("B", "C"), F.col("family")).otherwise(F.concat_ws(":", "family", "__dir", piece.cast("string")))
    return marked.select("path", "family", name.alias("grp"), (F.col("family") == "E").alias("mergeable"))


def ordered(members: DataFrame) -> DataFrame:
    """``grp, batch``: numbers from 1 on, larger groups first, then by their smallest path (``members``: grp, path)."""
    first = utf16_order(F.col("path"))
    per = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    return numbered(per, [F.desc("n"), F.col("first")], "batch", 1).select("grp", "batch")


def merged_small(members: DataFrame) -> DataFrame:
    """``path, batch``: groups (``path, grp, place, mergeable``) under SMALL files are pooled in path order, MERGED a batch; those that stay come first, in their order."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"), F.first("mergeable").alias("mergeable"))
    small = F.col("mergeable") & (F.col("n") < SMALL)
    keepers = numbered(sizes.where(~small).select("grp", "place"), [F.col("place")], "batch", 1).select("grp", "batch")
    kept = members.join(keepers, "grp").select("path", "batch")
    pooled = members.join(sizes.where(small).select("grp"), "grp", "left_semi").select("path")
    after = keepers.count() + 1
    placed = numbered(pooled, [utf16_order(F.col("path"))], "__at")
    return kept.unionByName(placed.select("path", (F.floor(F.col("__at") / MERGED) + after).cast("long").alias("batch")))


def changed_batches(batches: DataFrame, changed: DataFrame) -> DataFrame:
    """All rows of the batches (``path, batch``) that hold a changed file (``path``), under their own numbers; names are compared in normal form."""
    clean = F.regexp_replace(F.regexp_replace(F.translate(F.trim("path"), "\\", "/"), r"^\./+", ""), "/+", "/")
    hit = batches.join(changed.select(clean.alias("path")).distinct(), "path", "left_semi").select("batch").distinct()
    return batches.join(hit, "batch", "left_semi").select("path", "batch")


