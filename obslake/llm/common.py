"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit mixing constants (splitmix64).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that was set on the context.

    Where neither is set, a session on one machine gets a temporary folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='obslake-')}")
        at = context.getCheckpointDir()
    return at.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors. Deleted when the application ends."""
    name = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path, files = _path(df.sparkSession, name)
    files.deleteOnExit(path)
    return df.sparkSession.read.schema(df.schema).parquet(name)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a frame made by stored()."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path, files = _path(df.sparkSession, name)
        files.delete(path, True)


def sample(rows: DataFrame, *key: str, n: int) -> DataFrame:
    """n rows of rows at most: those with the smallest hash of `key`.

    A hash threshold leaves about 1.5 n rows before any is sorted, so no partition sends n rows of its own, however many partitions there are.
    """
    order = F.xxhash64(*key)
    share = 1.5 * n / max(1, rows.count())
    few = rows if share >= 1 else rows.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return few.orderBy(F.pmod(order, F.lit(1 << 30)), order, *key).limit(n)


#: Rows that go to a Python worker at once. A row is a whole document, so Spark's default of 10 000 would be many MB.
BATCH_ROWS = "1000"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that sends its rows to Python in small batches. The setting belongs to the session and stays lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= int(BATCH_ROWS):
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def release() -> None:
    """Give memory that a task no longer needs back to the system: Python workers are used again, by tasks of other stages too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this system
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *clear: Callable[[], None]):
    """run, for mapInArrow; `clear` and release() are called when a task's rows are done."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for c in clear:
                c()
            release()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of equal weight and compressed: small and near ones take little."""
    raw = np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True) if len(x) else b""


def unpack(b: bytes) -> np.ndarray:
    """Inverse of pack(), as uint64."""
    if not b:
        return np.empty(0, np.uint64)
    n = int.from_bytes(b[:4], "little")
    raw = np.frombuffer(pa.decompress(b[4:], 8 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted uint64 values as packed gaps."""
    return pack(np.diff(x, prepend=np.uint64(0))) if len(x) else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    """Inverse of pack_sorted()."""
    return np.cumsum(unpack(b), dtype=np.uint64)


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the edges a-b that aren't the smallest of their local component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        node, root = contract(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u long, v long), component being the smallest node reachable.

    Alternating large-star and small-star rounds: each is a pre-aggregated minimum per node and a join, so a hub is
    never gathered in one task. Edges are evaluated once; rounds are written to the shared folder; the loop ends when the
    edges stop changing, after a number of rounds that grows with the logarithm of the component size.
    Self-loops and null ends are ignored.
    """
    both = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).dropna().filter("u <> v")
    now, seen = stored(both.mapInArrow(_contract_batches, "u long, v long").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # large star: larger neighbours of a node go to its smallest neighbour
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: a node and its smaller neighbours go to the smallest of them
        large = large.mapInArrow(_contract_batches, "u long, v long").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v")
        after = stored(small.distinct(), "edges")
        drop_stored(now)
        now = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


#: A word is a run of anything but ASCII white space; bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
