"""Graph files: JSON in and out element by element, batch files, seeded synthetic graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE = "id string, type string, name string, filePath string, summary string, tags array<string>, complexity string"
EDGE = "source string, target string, type string, direction string, description string, weight string"


def _elements(files: DataFrame, field: str, schema: str) -> DataFrame:
    """Each element is parsed for itself: a bad one is null in ``r``, the others stay."""
    whole = files.select("file", "file_ord", F.from_json("value", f"{field} array<string>").getField(field).alias("xs"))
    return whole.select("file", "file_ord", F.posexplode("xs").alias("pos", "raw")).select("file", "raw", (F.shiftleft("file_ord", 32) + F.col("pos")).alias("ord"), F.from_json("raw", schema).alias("r"))


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and issues of all graph files under a path; files are ordered by batch number and part."""
    text = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    base = F.regexp_extract("file", r"([^/]+)$", 1)
    batch = F.when(base.startswith("batch-existing"), -1).otherwise(F.coalesce(F.regexp_extract(base, r"^batch-(\d+)", 1).try_cast("int"), F.lit(1 << 20)))
    part = F.coalesce(F.regexp_extract(base, r"-part-(\d+)", 1).try_cast("int"), F.lit(0))
    # files of a run, not rows of data: one small window
    files = text.withColumn("file_ord", F.row_number().over(Window.orderBy(batch, part, "file")).cast("long"))
    nodes, edges = _elements(files, "nodes", NODE), _elements(files, "edges", EDGE)
    sound_n, sound_e = F.col("r.id").isNotNull() & F.col("r.name").isNotNull(), F.col("r.source").isNotNull() & F.col("r.target").isNotNull()
    issues = nodes.where(~sound_n).select("file", F.lit("dropped node").alias("issue"), "raw").unionByName(edges.where(~sound_e).select("file", F.lit("dropped edge").alias("issue"), "raw"))
    return nodes.where(sound_n).select("r.*", "ord").withColumnRenamed("filePath", "file_path"), edges.where(sound_e).select("r.*", "ord"), issues


def batch_gaps(spark: SparkSession, names: list[str]) -> list[int]:
    """Numbers between the first and last batch file that no file has."""
    df = spark.createDataFrame([(n,) for n in names], "name string").select(F.regexp_extract("name", r"^batch-(\d+)", 1).try_cast("int").alias("k")).where("k is not null")
    row = df.agg(F.array_sort(F.collect_set("k")).alias("ks")).select(F.array_except(F.sequence(F.array_min("ks"), F.array_max("ks")), "ks").alias("gaps")).first()
    return list(row.gaps or [])


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines in two folders."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def synthetic(spark: SparkSession, n: int, per_node: float = 1.7, seed: int = 1, messy: bool = False) -> tuple[DataFrame, DataFrame]:
    """A seeded graph of n nodes; messy spoils about two nodes in five and one edge in five."""
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    kinds = F.array(*map(F.lit, ["file", "function", "class", "config", "document"]))
    bad = h("bad") < 0.4 if messy else F.lit(False)
    nodes = spark.range(n).select(
        F.concat(F.lit("file:n"), F.col("id").cast("string")).alias("node"), F.when(bad & (h("t") < 0.5), F.lit("FUNC")).otherwise(F.element_at(kinds, (h("k") * 5 + 1).cast("int"))).alias("type"),
        F.when(bad & (h("c") < 0.5), F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, ["simple", "moderate", "complex"])), (h("x") * 3 + 1).cast("int"))).alias("complexity"), F.col("id").alias("ord"),
    ).withColumnRenamed("node", "id")
    lost = h("lost") < 0.2 if messy else F.lit(False)
    edges = spark.range(int(n * per_node)).select(
        F.concat(F.lit("file:n"), F.floor(h("s") * n).cast("string")).alias("source"),
        F.when(lost, F.lit("file:ghost")).otherwise(F.concat(F.lit("file:n"), F.floor(h("g") * n).cast("string"))).alias("target"),
        F.element_at(F.array(*map(F.lit, ["imports", "calls", "contains", "depends_on"])), (h("e") * 4 + 1).cast("int")).alias("type"), F.lit("forward").alias("direction"), F.round(h("w"), 3).alias("weight"), F.col("id").alias("ord"),
    )
    return nodes, edges
