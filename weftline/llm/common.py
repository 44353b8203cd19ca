"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


#: A key is heavy with so many rows at least, and if one in so many rows has it.
HEAVY_ROWS, HEAVY_KEYS = 1000, 1000
#: Links from which on hubs are looked for.
MANY_LINKS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as there are cores, where a small input came in fewer pieces than that.

    Large inputs have more pieces than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is named."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    jvm, sc = spark._jvm, spark.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` gave, once nothing reads it any more."""
    at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if at.isDefined():
        remove(df.sparkSession, at.get())


def joined(rows: DataFrame, named: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with what ``named`` has for their key, without its column ``n``, the number of rows with that key.

    Keys that at least one in ``HEAVY_KEYS`` of the ``total`` rows have, which can be no more than
    that many keys, are sent to the rows; the others are shuffled.
    """
    heavy = [r[0] for r in named.where(F.col(n) >= max(HEAVY_ROWS, total // HEAVY_KEYS)).select(key).collect()]
    return split_join(rows, named.drop(n), key, heavy)


def split_join(rows: DataFrame, named: DataFrame, key: str, heavy: list) -> DataFrame:
    """A join in which the few keys ``heavy`` are sent to their rows."""
    if not heavy:
        return rows.join(named, key)
    is_heavy = F.col(key).isin(heavy)
    return rows.where(is_heavy).join(F.broadcast(named.where(is_heavy)), key).unionByName(rows.where(~is_heavy).join(named.where(~is_heavy), key))


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def string_views(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every value, without decoding; null gives empty bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def blocks(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together hold about ``most`` bytes; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))
    tidy()


def tidy() -> None:
    """Give memory that is free but kept back to the system; workers outlive their tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if trim := _libc_trim():
        trim(0)


@lru_cache(maxsize=1)
def _libc_trim():
    """``malloc_trim`` of glibc, None elsewhere."""
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def sorted_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deal rows by ``keys``, sort them, and give ``work`` tables that hold whole groups.

    A table ends where a group ends, so memory is that of one Arrow batch or of the largest
    group, whichever is more.  One shuffle; nothing is gathered outside its own task.
    """

    def run(batches):
        yield from work(_whole(batches, keys))
        tidy()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _whole(batches, keys):
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(k)
            if v.null_count:
                null = np.asarray(v.is_null())
                x = np.asarray(v.fill_null(0))
                change[1:] |= null[1:] != null[:-1]
            else:
                x = np.asarray(v)
            change[1:] |= x[1:] != x[:-1]
        if kept and all(kept[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys):
            at = np.flatnonzero(change)
            if not len(at):
                kept.append(batch)
                continue
            kept.append(batch.slice(0, int(at[0])))
            yield pa.Table.from_batches(kept)
            batch, change = batch.slice(int(at[0])), change[at[0]:]
        elif kept:
            yield pa.Table.from_batches(kept)
        last = int(np.flatnonzero(np.r_[True, change[1:]])[-1])
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        kept = [batch.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = False
    for c in columns:
        change[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def local_components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each node's component, by pointer jumping."""
    label = np.arange(n) if label is None else label.copy()
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of the links ``(u, v)`` as rows ``(node, root)``; root is the smallest node.

    Alternating large-star and small-star: each half round is one min per node (partial
    aggregates) and one join, in which the few hubs' mins are sent to the links, so a node with
    very many links is never gathered.  Roots themselves are included.  Links are cut from their
    lineage in the shared folder after each round, and those of the round before deleted.
    """
    links, total, seen = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None, None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = links.count() if total is None else total
        # A node has no more links in the small star than in this one.
        hubs = [r["u"] for r in both.groupBy("u").count().where(F.col("count") >= max(MANY_LINKS, total // HEAVY_KEYS)).collect()] if total >= MANY_LINKS else []
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = split_join(both.where("v > u"), low, "u", hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, "u", hubs).select(F.col("v"), F.col("m"), F.col("u"))
        before, links = links, cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        forget(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, total = now, now[0]
    else:
        raise RuntimeError("the components have not settled")
    return links.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
