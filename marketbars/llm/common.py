"""What the text operators share: tables, the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local one is set in local mode (tests); a cluster needs one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The folders that new_dir() named inside a temporary() block.
_named: list[list[str]] = []


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _named:
        _named[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """All folders named inside are deleted at its end: what is to stay has to be written to a folder named outside."""
    _named.append([])
    try:
        yield
    finally:
        for path in _named.pop():
            drop_dir(spark, path)


def keep(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_dir() named."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A value is hot if more than 1/HOT of the rows have it: so at most HOT values are.
HOT, SALTS = 200, 64


def hot_values(counts: DataFrame, value: str, n: str, total: int) -> list:
    """The hot values of a table of counts; at most HOT of them reach the driver."""
    return [r[0] for r in counts.where(F.col(n) > total / HOT).select(value).distinct().limit(HOT).collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: list, how: str = "inner", by: Column | None = None) -> DataFrame:
    """left.join(right, keys, how) in which rows of left with a hot value of the first key are dealt over SALTS tasks, by `by` or by turns.

    The rows of right that a hot value has are repeated SALTS times; right has few rows for each key.
    """
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.col(keys[0]).isin(hot)
    turn = F.pmod(F.monotonically_increasing_id() if by is None else F.xxhash64(by), F.lit(SALTS)).cast("int")
    salted = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.withColumn("_salt", F.when(is_hot, turn).otherwise(0)).join(salted, [*keys, "_salt"], how).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node that can be reached.

    Rounds of contraction: each node goes to its smallest neighbour (itself included) and on to where that one goes,
    and links between different places make the next, smaller round; the rows of all rounds together are a small
    multiple of the links. At the end the ways are put together from the last round back. Each round is written to the
    shared folder. Only the number of links left reaches the driver, and the nodes of very many links (at most HOT),
    whose rows are dealt over many tasks. Self-links, repeated links and nulls do no harm (rows with a null end are dropped).
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    pairs = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    edges, ways = keep(pairs(links), "edges"), []
    while n := edges.count():
        ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = hot_values(ends.groupBy("a").count(), "a", "count", n)
        up = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("up"))
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("label"))
        way = keep(spread_join(up, jump, ["up"], hubs, by=F.col("node")).select("node", "label"), "ways")
        to = lambda end: way.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}"))  # noqa: B023, E731
        moved = spread_join(spread_join(edges, to("a"), ["a"], hubs, by=F.col("b")), to("b"), ["b"], hubs, by=F.col("a"))
        edges = keep(pairs(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "edges")
        ways.append(way)
    whole = None
    for way in reversed(ways):
        if whole is not None:
            on = whole.select(F.col("node").alias("label"), F.col("label").alias("last"))
            way = way.join(on, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
        whole = keep(way, "labels")
    return nodes.withColumn("label", F.col("node")) if whole is None else nodes.join(whole, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
