"""Scratch tables in the cluster's shared folder, connected components and small helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table that may be broadcast after they have been counted; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Edges, counted first, that one task may hold to find components at once; beyond it rounds of joins do.
TASK_EDGES = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="parlance-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage; written once, they survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.count = spark, 0
        self.live: dict[str, int] = {}
        self.root = f"{shared_folder(spark)}/parlance-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        self.live[path] = self.count
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.spark.sparkContext._jvm.System.gc()  # Spark deletes shuffle files of what has been collected
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *frames: DataFrame) -> None:
        """Frees tables that no later plan reads."""
        for df in frames:
            self.live.pop(df.scratch_path, None)
            self._delete(df.scratch_path)

    def release(self, since: int, *keep: DataFrame) -> None:
        """Frees all tables after number `since` but those to keep."""
        kept = {df.scratch_path for df in keep if hasattr(df, "scratch_path")}
        for path in [p for p, n in self.live.items() if n > since and p not in kept]:
            del self.live[path]
            self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended
            pass


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes too, so that very long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def maybe_broadcast(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """keys with a broadcast hint if it has been counted to have at most limit rows."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def checksum(df: DataFrame, *cols: str) -> tuple:
    """Number of rows and an order-free sum of their hashes."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _united(batches):
    """(id, label) of all edges (u, v) of one task, by union-find."""
    at: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := at.setdefault(x, x)) != x:
            at[x] = x = at[up]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            at[max(x, y)] = min(x, y)
    if at:
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([root(x) for x in at], pa.int64())], ["id", "label"])


def components(edges: DataFrame, scratch: Scratch, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, label) for each id in edges (a, b): label is the least id that it reaches.

    Up to task_edges edges are united in one executor task. More are taken through large-star and
    small-star steps on joins and combinable minima until nothing changes; no neighbour list is ever
    collected, so a hub is only many rows that adaptive joins can split.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = checksum(e, "u", "v")
    if before[0] <= task_edges:
        out = scratch.save(e.coalesce(1).mapInArrow(_united, "id long, label long"))
        scratch.drop(e)
        return out
    while before[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(e)
        e, now = after, checksum(after, "u", "v")
        if now == before:
            break
        before = now
    return scratch.save(e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()))


def text_key(text: str = "text") -> Column:
    """A hash that stands for a text: rows with equal texts share it."""
    return F.xxhash64(F.col(text))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each made to differ from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_{n}"
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def with_ids(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra ones, whatever they are called, never enter a plan."""
    return df.select(*[F.col(f"`{n}`") for n in names])
