"""Shared pieces of the training-data operators: written tables, word hashing and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes of text that one numpy step handles at a time inside a task.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one, set once, only where the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='vitrine-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may have ended before the interpreter
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors.

    The table goes when the application ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/vitrine-{spark.sparkContext.applicationId}"
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_sweep, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vitrine_path = path
    return out


def fresh(df: DataFrame) -> str:
    """Underscores with which no column of ``df`` begins: names made with them clash with none."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing needs any more."""
    _delete(df.sparkSession, df._vitrine_path)


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    a = a ^ (a >> np.uint64(30))
    a = a * _MIX[1]
    a = a ^ (a >> np.uint64(27))
    a = a * _MIX[2]
    return a ^ (a >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per word a 64-bit hash, and the offsets of each text's words.

    Words are runs of anything but space and tab to carriage return, with A-Z lower-cased."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    flat = words.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(full)))[words.offsets.to_numpy() - words.offsets[0].as_py()] if len(texts) else np.zeros(1, np.int64)
    coded = flat.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if not full.all():
        codes = codes[full]
    return (each[codes] if len(codes) else np.zeros(0, np.uint64)), at


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that start at each word; across texts too, which callers cut off."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ h[j : j + n]) * _MIX[0]
            out ^= out >> np.uint64(29)
        return mix(out)


def slices(batch: pa.RecordBatch, text: str):
    """Parts of the batch of about SLICE_BYTES of text, a single long text at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def local_forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, root) of a spanning forest of the given links; the root is the smallest id."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in parent if root(x) != x]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table of longs: ``node``, ``component`` (its smallest node).

    Each round hooks every node to its smallest neighbour, shortens the pointers once and contracts
    the edges, so the graph shrinks geometrically. All tables are written to the shared folder; nothing but a
    count of the edges that remain comes to the driver. Nulls and self-links are ignored; an empty edge table
    gives no rows."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    label = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "hook")
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        short = written(hook.join(up, "p").select("u", F.col("pp").alias("p")), "short")
        forget(hook)
        if label is None:
            new = short.select(F.col("u").alias("node"), F.col("p").alias("component"))
            label, old = written(new, "label"), None
        else:
            step = short.select(F.col("u").alias("component"), F.col("p"))
            new = label.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
            label, old = written(new, "label"), label
        to = short.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        nxt = e.join(short.withColumnRenamed("p", "pu"), "u").join(to, "v").where("pu <> pv")
        nxt = nxt.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        e, gone = written(nxt, "edges"), e
        for t in (gone, short, *([old] if old is not None else [])):
            forget(t)
    if label is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label
