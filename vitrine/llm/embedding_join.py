"""Embedding near-dedup: an exact metric range join of unit vectors.

On unit vectors ``cosine >= c`` is ``distance <= r`` with ``r = sqrt(2 - 2c)``. Pivots cut each group into cells: a
vector lives in the cell of its nearest pivot. By the triangle inequality a partner of a vector lives in the cell of
pivot ``q`` only if the vector is within ``r`` of the plane between ``q`` and its own pivot ``p``, that is
``d(x,q)^2 - d(x,p)^2 <= 2 r d(p,q)``, and ``d(x,q) <= d(x,p) + 2r``; to those cells it is replicated. Each cell then
finds all partners of the vectors that live there, alone. Equal vectors are one class first. Large cells are cut into
blocks, so no task holds a cell whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import components, local_forest, written

#: Pivots in all, which bounds what the driver sends out: 2 MB at 128 dimensions. Cells beyond that size are cut.
MAX_PIVOTS = 2048
#: Classes of a cell, on average, until there are MAX_PIVOTS cells.
CELL = 600
#: Vectors on each side of a block.
BLOCK = 1024
KEYS = ["grp", "cell", "homes", "others"]


def _unit(key: str):
    """mapInArrow over (key, label, embedding): unit vectors as binary, their group and signature; null where the
    vector or label can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            labels, groups, sigs, vecs = batch.column("label").to_pylist(), [], [], []
            for label, v in zip(labels, batch.column("embedding")):
                x = None
                if label is not None and v.is_valid and v.values.null_count == 0 and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    x = x / top / np.sqrt(np.square(x / top).sum()) if np.isfinite(top) and top > 0 else None
                group = None if x is None else f"{len(x)}:{label}"
                groups.append(group)
                vecs.append(None if x is None else x.tobytes())
                sigs.append(None if x is None else xxhash.xxh3_128_digest(group.encode() + b"\0" + vecs[-1]))
            columns = [batch.column(key), pa.array(groups, pa.string()), pa.array(sigs, pa.binary()), pa.array(vecs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "grp", "sig", "vec"])

    return run


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _cells(pivots: dict[str, np.ndarray], r: float):
    """mapInArrow over classes: a row per cell where the class lives (home) or is needed. A group without a pivot is
    one cell."""
    slack = 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), object)
            take, cell, home = [], [], []
            for g in sorted(set(groups)):
                at = np.flatnonzero(groups == g)
                p = pivots.get(g)
                if p is None:
                    take, cell, home = [*take, at], [*cell, np.full(len(at), -1)], [*home, np.ones(len(at), bool)]
                    continue
                x = _matrix(batch.column("vec").take(pa.array(at)).to_pylist())
                d2 = np.maximum(0, 2 - 2 * x @ p.T)
                own = d2.argmin(1)
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[own]
                near = d2[np.arange(len(at)), own][:, None]
                needed = (d2 - near <= 2 * r * between + slack) & (np.sqrt(d2) <= np.sqrt(near) + 2 * r + slack)
                needed[np.arange(len(at)), own] = True
                i, c = np.nonzero(needed)
                take, cell, home = [*take, at[i]], [*cell, c], [*home, c == own[i]]
            if not take:
                continue
            rows = pa.array(np.concatenate(take))
            columns = [*(batch.column(c).take(rows) for c in ("grp", "rep", "copies", "vec")), pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(home))]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "rep", "copies", "vec", "cell", "home"])

    return run


def _blocks(cosine: float):
    """mapInArrow over rows sorted by block: partners of the block's home side. Yields forest edges (a, b) and, per
    home class, the number of vectors linked (b null)."""

    def links(homes: list, others: list) -> pa.RecordBatch:
        a, b = (np.array([r[0] for r in side], np.int64) for side in (homes, others))
        copies = np.array([r[1] for r in others], np.int64)
        linked = _matrix([r[2] for r in homes]) @ _matrix([r[2] for r in others]).T >= cosine
        linked &= a[:, None] != b[None, :]
        i, j = np.nonzero(linked)
        forest = local_forest(a[i], b[j])
        n = linked @ copies
        some = np.flatnonzero(n)
        left = np.array([*(x for x, _ in forest), *a[some]], np.int64)
        right = pa.array([*(y for _, y in forest), *[None] * len(some)], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(left), right, pa.array(np.concatenate([np.zeros(len(forest), np.int64), n[some]]))], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*KEYS, "side", "rep", "copies", "vec")]
            for row in zip(*columns):
                if row[:4] != key:
                    if all(sides):
                        yield links(*sides)
                    key, sides = row[:4], ([], [])
                sides[row[4]].append(row[5:])
        if all(sides):
            yield links(*sides)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id") -> DataFrame:
    """Link vectors of equal labels (``key`` long, ``embedding`` array, ``label``) whose cosine, in double precision, is at least
    ``cosine``.

    Returns one row per input row: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest
    vec_id reachable by links, itself included), ``kept`` (vec_id = component_id). Vectors of different lengths,
    null labels, and vectors that are null, empty, zero or hold null or non-finite components link with nothing. A
    null id keeps its row, with no part in links. Ids should be unique. Further columns are ignored; an empty table gives no rows."""
    r = float(np.sqrt(2 - 2 * cosine))
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["label"]
    made = vectors.select(F.col(key).cast("long").alias(key), F.col("label").cast("string") if kind == "string" else "label", "embedding")
    made = written(made.mapInArrow(_unit(key), "vec_id long, grp string, sig binary, vec binary"), "units")
    able = made.where("sig IS NOT NULL AND vec_id IS NOT NULL")
    classes = able.groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("grp").alias("grp"), F.first("vec").alias("vec"))
    classes = written(classes, "classes")
    n_pivots = min(MAX_PIVOTS, -(-classes.count() // CELL))
    chosen = classes.select("grp", "vec", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(n_pivots).collect() if n_pivots else []
    pivots = {g: _matrix([c["vec"] for c in chosen if c["grp"] == g]) for g in {c["grp"] for c in chosen}}

    placed = classes.select("grp", "rep", "copies", "vec").mapInArrow(_cells(pivots, r), "grp string, rep long, copies long, vec binary, cell int, home boolean")
    placed = written(placed, "cells")
    size = placed.groupBy("grp", "cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("nh"), F.ceil(F.count("*") / BLOCK).cast("int").alias("no"))
    placed = placed.join(size.where("nh > 0"), ["grp", "cell"])
    part = lambda n: F.pmod(F.xxhash64(F.lit(3), "rep"), F.col(n)).cast("int")
    as_home = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda o: F.struct(part("nh").alias("homes"), o.cast("int").alias("others"), F.lit(0).alias("side"))))
    as_other = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda h: F.struct(h.cast("int").alias("homes"), part("no").alias("others"), F.lit(1).alias("side")))
    both = F.concat(F.coalesce(as_home, F.array().cast("array<struct<homes:int,others:int,side:int>>")), as_other)
    rows = placed.select("grp", "cell", "rep", "copies", "vec", F.explode(both).alias("k")).select("grp", "cell", "k.*", "rep", "copies", "vec")
    rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS).select(*KEYS, "side", "rep", "copies", "vec")
    found = written(rows.mapInArrow(_blocks(cosine), "a long, b long, links long"), "links")

    component = components(found.where("b IS NOT NULL")).withColumnRenamed("node", "rep")
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of = classes.select("sig", "rep", "copies").join(linked, "rep", "left").join(component, "rep", "left")
    of = written(of.select("sig", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "class-components")
    joined = able.select("vec_id", "sig").join(of, "sig", "left").select("vec_id", "n_links", "component_id")
    alone = made.where("sig IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
