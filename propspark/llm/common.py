"""What several operators share: table reads, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, which separates words in all operators.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: bytes.translate table: A-Z to lower case, all else as it is.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_LOCAL: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds a batch of long texts: about 1 MB each to Python, 256 rows at once from Parquet.

    By rows alone, as is the default, a batch grows with its texts, and an executor holds several
    in its heap, beside it and in Python. The settings are the session's; they say how many rows
    go at a time, not which.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's spark.checkpoint.dir. Where that is unset, a local master gets a
    temporary folder of this machine, any other the session's warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
        return _LOCAL[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends in order."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def store(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def row_key(df: DataFrame) -> Column:
    """The same 64-bit hash for rows that are equal in every column; lists, maps and structs count as JSON."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    flat = [F.col(f"`{c}`") for c in df.columns if c not in nested]
    there = [c.isNull() for c in flat]  # a hash passes over nulls
    return F.xxhash64(*flat, *there, *[F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) for c in nested])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many marks behind it as it takes to be no column of `df`."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of `links` (a long, b long): the smallest node reachable.

    Contraction: in each round nodes get a new random order, every node points to the first
    of itself and its neighbours, pointers are followed once more, links are moved to where
    their ends point, and those within one node go. A random order leaves a fixed share of
    the nodes at most, so the rounds are logarithmic, also for chains. Each round's tables
    are written to the shared folder. Only the test for an empty table returns to the
    driver. Nodes without links to others are left out.
    """
    spark = links.sparkSession
    edges = store(links.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), f"{label}-links")
    member, turn = None, 0
    while not empty(edges):
        turn += 1
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(place("b")).alias("b")).select(F.col("a").alias("node"), F.least(place("a"), "b")["n"].alias("to"))
        near = store(near, f"{label}-near")
        further = near.selectExpr("node AS to", "to AS next")
        near = store(near.join(further, "to").selectExpr("node", "next AS to"), f"{label}-step")
        ends = edges.join(near.selectExpr("node AS a", "to AS new_a"), "a").join(near.selectExpr("node AS b", "to AS new_b"), "b")
        moved = ends.where("new_a <> new_b").selectExpr("least(new_a, new_b) AS a", "greatest(new_a, new_b) AS b").distinct()
        edges = store(moved, f"{label}-links")
        if member is None:
            member = near.selectExpr("node", "to AS component")
        else:
            step = near.selectExpr("node AS component", "to")
            member = store(member.join(step, "component", "left").selectExpr("node", "coalesce(to, component) AS component"), f"{label}-member")
    if member is None:
        return spark.createDataFrame([], "node long, component long")
    least = member.groupBy("component").agg(F.min("node").alias("least"))
    return member.join(least, "component").selectExpr("node", "least AS component")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def language_group(docs: DataFrame, lang_col: str, languages: tuple[str, ...]) -> Column:
    """Position of the language in `languages`; their number for others, nulls and tables without the column."""
    found = F.lit(len(languages))
    if lang_col in docs.columns:
        for i, name in enumerate(languages):
            found = F.when(F.col(lang_col) == name, i).otherwise(found)
    return found.cast("long")
