"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The product of the incidence matrix with its transpose holds the overlap of every two documents. It is never formed
whole. Bounds that follow from the set sizes alone discard most of it first:

* Documents with equal sets are one class; one row stands for it.
* Two sets that reach the threshold share an n-gram among the first ``n - ceil(t n) + 1`` of either in any fixed
  order. The order is by hash with frequent n-grams last, so that widely shared passages join nobody. Which are
  frequent is counted over all documents, in cells of the lower half of the hashes; prefixes seldom reach beyond it.
* Over those rare columns the overlap counts of each pair accumulate; pairs whose count, plus what the sets hold beyond
  the prefix that ends first, stays below the bound are discarded, then pairs whose 64-bin histograms differ too much.
* Columns that many classes still share link classes that are neighbours by size, if their sizes are near enough, into
  families without forming pairs. These are documents of which most n-grams are frequent: large groups of near copies.

What is left are families of likely copies. Each is cut into blocks by size, and blocks of compatible sizes are
multiplied: dense partial products over slices of the shared columns add up to exact overlaps of whole sets. No step
depends on a cap; the length of the frequent list and the block size change the work and not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import SLICE_BYTES, components, forget, local_forest, mix, rolled, slices, word_hashes, written

#: N-grams in more sets than this are frequent, and columns that more classes share link families instead of pairs.
WIDE = 32
#: Frequent n-grams that come last in the order, at most: 4 MB.
LATE = 1 << 20
#: Ranges of cells that are counted apart: a range has 2^31 / RANGES cells, which bounds the memory of its counts (16 MB).
RANGES = 512
#: Classes of a block, and the n-grams of all its sets together; a family of up to twice as many is not cut.
BLOCK, BLOCK_NGRAMS = 1024, 2_000_000
#: log2 of the bits of the filter that keeps texts of no family out of a shuffle, at most: 16 MB.
FILTER_LG = 27
#: Parts over which the classes of a component are dealt.
SALT = 8
#: Hashes that a task gathers before it counts them.
GATHER = 2_000_000
#: Frequent n-grams are told by the upper 32 bits of hashes below this one.
HALF = np.uint64(1 << 63)


def sets_of(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; with fewer words, of the whole sequence."""
    h, at = word_hashes(texts)
    windows, at = rolled(h, k), at.tolist()
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(at, at[1:]):
            n = b - a
            if n >= k:
                out.append(np.unique(windows[a : b - k + 1]))
            else:
                out.append(mix(rolled(h[a:b], n) + np.uint64(n)) if n else h[:0])
    return out


def _cells(a: np.ndarray) -> np.ndarray:
    """The cells of a sorted set's hashes below HALF."""
    return (a[: np.searchsorted(a, HALF)] >> np.uint64(32)).astype(np.uint32)


def _count_sets(k: int, gather: int):
    """mapInArrow over texts: how many different sets of the task hold each cell, by ranges of cells.

    A row is a range, its sorted cells as differences and their counts, both compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        squeeze, width = zstandard.ZstdCompressor(level=1).compress, (1 << 31) // RANGES
        seen, some, held = set(), [], 0

        def flush():
            cells, n = np.unique(np.concatenate(some), return_counts=True)
            number = cells // np.uint32(width)
            starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            rows = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]):
                step = np.diff(cells[i:j], prepend=np.uint32(0)).astype(np.uint32)
                rows.append((int(number[i]), squeeze(step.view(np.uint8).reshape(-1, 4).T.tobytes()), squeeze(n[i:j].astype(np.uint32).tobytes())))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["part", "cells", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for a in sets_of(part.column("text"), k):
                    if len(a) and (sig := xxhash.xxh3_64_intdigest(a)) not in seen:
                        seen.add(sig)
                        some.append(_cells(a))
                        held += len(some[-1])
                    if held > gather:
                        yield flush()
                        seen, some, held = set(), [], 0
        if held:
            yield flush()

    return run


def _frequent_cells(wide: int):
    """mapInArrow over rows of _count_sets sorted by range: cells that more than ``wide`` sets hold, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, width = zstandard.ZstdDecompressor().decompress, (1 << 31) // RANGES
        part, counts = None, np.zeros(width, np.uint32)

        def flush():
            at = np.flatnonzero(counts > wide)
            return pa.RecordBatch.from_arrays([pa.array(at + part * width), pa.array(counts[at].astype(np.int64))], ["cell", "c"])

        for batch in batches:
            for p, cells, n in zip(*(batch.column(c).to_pylist() for c in ("part", "cells", "n"))):
                if p != part:
                    if part is not None:
                        yield flush()
                    part = p
                    counts[:] = 0
                step = np.ascontiguousarray(np.frombuffer(expand(cells), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                counts[np.cumsum(step, dtype=np.int64) - p * width] += np.frombuffer(expand(n), np.uint32)
        if part is not None:
            yield flush()

    return run


def _late(texts: DataFrame, k: int) -> np.ndarray:
    """The cells of the most frequent n-grams, LATE at most, sorted. Any list gives the same result of the join."""
    counted = texts.mapInArrow(_count_sets(k, GATHER), "part long, cells binary, n binary").repartition("part").sortWithinPartitions("part")
    counted = written(counted.mapInArrow(_frequent_cells(WIDE), "cell long, c long"), "frequent")
    n = counted.count()
    some = counted if n <= LATE else counted.where(F.col("c") > counted.agg(F.percentile_approx("c", 1 - LATE / n, 10_000)).first()[0])
    cells = some.select("cell").limit(LATE).toArrow().column("cell").to_numpy()
    forget(counted)
    return np.sort(cells.astype(np.uint32))


def _prefixes(k: int, percent: int, late: np.ndarray):
    """mapInArrow over (doc_id, text): a hash of the text, set size, the set's signature and number, its prefix and its
    histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part.column("text"), k)
                sizes = np.array([len(a) for a in sets], np.int64)
                cells = [_cells(a) for a in sets]
                flat = np.concatenate([*cells, np.zeros(0, np.uint32)])
                at = np.searchsorted(late, flat)
                is_late = late[np.minimum(at, len(late) - 1)] == flat if len(late) else np.zeros(len(flat), bool)
                prefixes, sigs, hists, ends, i = [], [], [], [], 0
                for a, c in zip(sets, cells):
                    n, m = len(a), is_late[i : i + len(c)]
                    i += len(c)
                    p, rare = n - -(-percent * n // 100) + 1 if n else 0, n
                    if m.any():
                        m = np.concatenate([m, np.zeros(n - len(c), bool)])
                        a = np.concatenate([a[~m], a[m]])
                        rare = n - int(m.sum())
                    prefixes.append(a[:p])
                    # where the prefix ends in the order: frequent n-grams come last
                    ends.append((int(a[p - 1]) >> 2) + ((p > rare) << 62) if n else None)
                    hists.append(np.minimum(np.bincount((a & np.uint64(63)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes())
                for a in sets:
                    sigs.append(xxhash.xxh3_128_digest(a) if len(a) else None)
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                values = pa.array(np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64))
                columns = [part.column("doc_id"), pa.array(_text_hashes(part.column("text"))), pa.array(sizes), pa.array(sigs, pa.binary())]
                columns += [pa.array([s and int.from_bytes(s[:8], "little", signed=True) for s in sigs], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(ends, pa.int64()), pa.array(hists, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_shingles", "sig", "node", "prefix", "end", "hist"])

    return run


def _text_hashes(texts: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t or "") for t in texts.to_pylist()], np.uint64).view(np.int64)


def _near_histograms(percent: int):
    """mapInArrow over pairs with both histograms: drops those that are too far apart.

    The histograms' distance is at most the size of the symmetric difference, and that is at most
    (100 - t) / (100 + t) of the sizes' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 64).astype(np.int16) for c in ("ha", "hb"))
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            near = np.abs(x - y).sum(1) * (100 + percent) <= (100 - percent) * total
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])

    return run


def overlaps(sets: list[np.ndarray], width: int = 2048, parts: int = 8) -> np.ndarray:
    """Sizes of all intersections: the product of the incidence matrix with its transpose, in slices of columns.

    Columns are taken by ranges of their hashes, which bounds the memory beside the result; counts up to 2^24 are exact."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    bounds = [np.uint64(i * (2**64 // parts)) for i in range(1, parts)]
    cut = np.array([[0, *np.searchsorted(s, bounds), len(s)] for s in sets])
    for p in range(parts):
        some = [s[c[p] : c[p + 1]] for s, c in zip(sets, cut)]
        flat, row = np.concatenate(some), np.repeat(np.arange(n, dtype=np.int32), cut[:, p + 1] - cut[:, p])
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        first = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(first), len(flat)))
        shared = np.repeat(size > 1, size)
        column = np.repeat(np.cumsum(size > 1) - 1, size)[shared]
        row = row[shared]
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            i, j = np.searchsorted(column, (a, a + width))
            x = np.zeros((n, int(column[j - 1]) - a + 1), np.float32)
            x[row[i:j], column[i:j] - a] = 1
            out += x @ x.T
    return out


def _bitmap(ids: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """log2 of the size, and the bits, of a filter of hashed ids; its size is bounded whatever their number."""
    lg = min(FILTER_LG, max(15, (16 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << lg))
    rows = ids.select(F.bitmap_bucket_number(bit + 1).alias("k"), F.bitmap_bit_position(bit + 1).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b").alias("bits")).collect()
    out = np.zeros(1 << lg, bool)
    for r in rows:
        at = (r["k"] - 1) * 32768
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        out[at : at + len(bits)] = bits
    return lg, np.packbits(out)


def _packed(lg: int, bits: np.ndarray):
    """mapInArrow over (doc_id, text, bit): hashed and compressed texts of the rows that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            at = np.flatnonzero(bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            text = batch.column("text").take(pa.array(at))
            columns = [batch.column("doc_id").take(pa.array(at)), pa.array(_text_hashes(text)), pa.array([squeeze(x.encode()) for x in text.to_pylist()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "text"])

    return run


KEYS = ["family", "lband", "lpart", "rband", "rpart"]


def _products(k: int, percent: int):
    """mapInArrow over rows sorted by block pair: links between the classes of each block pair.

    Yields a spanning forest of the links (a, b) and, per class, the number of documents linked (b null)."""

    def links(side: list[int], ids: np.ndarray, weight: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        o, n, side = overlaps(sets), np.array([len(s) for s in sets]), np.array(side)
        linked = np.zeros(o.shape, bool)
        for a in range(0, len(n), 256):
            rows = slice(a, a + 256)
            near = o[rows].astype(np.int64) * (100 + percent) >= percent * (n[rows, None] + n[None, :])
            linked[rows] = near & ((side[rows, None] == 2) | (side[rows, None] != side[None, :]))
        del o
        np.fill_diagonal(linked, False)
        i, j = np.nonzero(np.triu(linked))
        forest = local_forest(ids[i], ids[j])
        docs = np.array([weight[r].sum() for r in linked], np.int64)
        some = np.flatnonzero(docs)
        a = np.array([*(x for x, _ in forest), *ids[some]], np.int64)
        b = pa.array([*(y for _, y in forest), *[None] * len(some)], pa.int64())
        count = np.concatenate([np.zeros(len(forest), np.int64), docs[some]])
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(count)], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        key, side, ids, weight, texts = None, [], [], [], []

        def sets() -> list[np.ndarray]:
            out, some, size = [], [], 0
            for text in texts:
                some.append(expand(text))
                size += len(some[-1])
                if size > SLICE_BYTES:
                    out, some, size = [*out, *sets_of(pa.array(some, pa.binary()).cast(pa.string()), k)], [], 0
            return [*out, *sets_of(pa.array(some, pa.binary()).cast(pa.string()), k)]

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "side", "node", "copies", "text"))):
                if row[:5] != key:
                    if len(ids) > 1:
                        yield links(side, np.array(ids), np.array(weight), sets())
                    key, side, ids, weight, texts = row[:5], [], [], [], []
                if ids and row[6] == ids[-1]:  # a row that repeats its id
                    continue
                side.append(row[5])
                ids.append(row[6])
                weight.append(row[7])
                texts.append(row[8])
        if len(ids) > 1:
            yield links(side, np.array(ids), np.array(weight), sets())

    return run


def _block_pairs(members: DataFrame) -> DataFrame:
    """Rows of (node, doc_id, th, copies, block pair, side) for classes with ``family`` and ``n``.

    Families of up to twice a block are one. Larger ones are cut by size, in bands of a quarter, and by hash; blocks
    of the same and of neighbouring bands meet."""
    blocks = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_NGRAMS)
    total = members.groupBy("family").agg((blocks <= 2).alias("_whole"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    m = written(members.join(total, "family").withColumn("band", F.when(F.col("_whole"), F.lit(0)).otherwise(band)), "members")
    parts = m.groupBy("family", "band").agg(F.when(F.first("_whole"), 1).otherwise(F.ceil(blocks)).cast("int").alias("parts"))
    parts = written(parts, "parts")
    near = lambda d, name: parts.select("family", (F.col("band") - d).alias("band"), F.col("parts").alias(name))
    m = m.join(parts, ["family", "band"]).join(near(-1, "below"), ["family", "band"], "left").join(near(1, "above"), ["family", "band"], "left")
    m = m.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("parts")).cast("int"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    count_up = lambda to: F.filter(F.sequence(F.lit(0), to), lambda x: x < to)
    key = lambda lb, lp, rb, rp, side: F.struct(lb.cast("int").alias("lband"), lp.cast("int").alias("lpart"), rb.cast("int").alias("rband"), rp.cast("int").alias("rpart"), side.cast("int").alias("side"))
    band, part = F.col("band"), F.col("part")
    own = F.transform(count_up(F.col("parts")), lambda x: key(band, F.least(part, x), band, F.greatest(part, x), F.when(x == part, 2).when(x > part, 0).otherwise(1)))
    up = F.transform(count_up(n("above")), lambda x: key(band, part, band + 1, x, F.lit(0)))
    down = F.transform(count_up(n("below")), lambda x: key(band - 1, x, band, part, F.lit(1)))
    who = ["node", "doc_id", "th", "copies", "family"]
    return m.select(*who, F.explode(F.concat(own, up, down)).alias("_k")).select(*who, "_k.*")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Jaccard join of ``docs`` (``doc_id`` long, ``text``) on distinct k-word shingles.

    Two documents link when ``100 * intersection >= percent * union``. Returns one row per input row: ``doc_id``,
    ``n_shingles``, ``n_links`` (other rows linked directly) and ``component_id`` (smallest doc_id reachable by links, itself
    included). Words are runs of non-white-space, A-Z lower-cased; a text with fewer than k words is one shingle; a
    null or empty one has none and links with nothing. Ids should be unique: rows with one id are rows of their own, equal
    ones are linked as copies, and each different text has its own links. A null id keeps its row, with its class's
    component, or a null where no row of the class has an id; it counts in no links. Further columns are ignored; an empty
    table gives no rows."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    late = _late(text.select("text"), k)
    made = written(text.mapInArrow(_prefixes(k, percent, late), "doc_id long, th long, n_shingles long, sig binary, node long, prefix array<long>, end long, hist binary"), "prefixes")
    docs = written(made.select("doc_id", "n_shingles", "sig", "node"), "documents")

    # a class is told by its set's signature, so that one id may stand in several
    able = made.where("sig IS NOT NULL AND doc_id IS NOT NULL")
    classes = able.groupBy("node", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.select("node", "n", "rep.doc_id", "rep.th", "copies"), "classes")

    rows = able.join(classes.select("node", "doc_id", "th", "n"), ["node", "doc_id", "th"]).select("node", "n", "prefix", "end", "hist")
    one = written(rows.dropDuplicates(["node"]), "class-prefixes")
    forget(made)
    entries = one.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    column, by_size = Window.partitionBy("h"), Window.partitionBy("h").orderBy("n", "node")
    entries = entries.withColumns({"df": F.count("*").over(column), "before": F.lag(F.struct("node", "n")).over(by_size)}).where("df > 1")
    entries = written(entries, "entries")

    need = lambda: F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    narrow = entries.where(F.col("df") <= WIDE)
    left = narrow.select("h", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    right = narrow.select("h", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    fits = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    fits &= F.least("pa", "pb") + 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= need()
    pairs = left.join(right, "h").where(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    wide = entries.where(F.col("df") > WIDE)
    per = written(one.select("node", "end", F.size("prefix").alias("p"), "hist").join(wide.groupBy("node").agg(F.count("*").alias("w")), "node", "left").fillna(0, ["w"]), "histograms")
    forget(one)
    pairs = pairs.join(per.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("end", "p", "hist", "w")]), "a")
    pairs = pairs.join(per.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("end", "p", "hist", "w")]), "b")
    # all that the sets share up to the end of the prefix that ends first is counted, wide columns aside
    rest = F.when(F.col("end_a") < F.col("end_b"), F.least(F.col("na") - F.col("p_a"), F.col("nb") - F.col("pb") - 1))
    rest = rest.when(F.col("end_a") > F.col("end_b"), F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("p_b")))
    rest = rest.otherwise(F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1))
    pairs = pairs.where(F.col("c") + F.least("w_a", "w_b") + rest >= need()).select("a", "b", "na", "nb", F.col("hist_a").alias("ha"), F.col("hist_b").alias("hb"))
    likely = written(pairs.mapInArrow(_near_histograms(percent), "a long, b long"), "likely")
    # neighbours by size: no pair reaches over a gap in the sizes
    chain = wide.where(F.lit(100) * F.col("before.n") >= F.lit(percent) * F.col("n")).select(F.col("node").alias("a"), F.col("before.node").alias("b"))
    family = components(likely.unionByName(chain))

    members = family.select("node", F.col("component").alias("family")).join(classes.select("node", "n", "doc_id", "th", "copies"), "node")
    members = written(members, "family-members")
    for t in (entries, per, likely):
        forget(t)
    rows = written(_block_pairs(members), "blocks")
    lg, bits = _bitmap(members.select("doc_id"), "doc_id")
    packed = text.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(1 << lg)))
    packed = packed.mapInArrow(_packed(lg, bits), "doc_id long, th long, text binary")
    rows = packed.join(rows, ["doc_id", "th"]).select(*KEYS, "side", "node", "copies", "text")
    rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "node")
    found = written(rows.mapInArrow(_products(k, percent), "a long, b long, links long"), "links")

    component = components(found.where("b IS NOT NULL"))
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    of = classes.select("node", "doc_id", "copies").join(linked, "node", "left").join(component, "node", "left")
    of = written(of.select("node", "doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "class-links")
    # classes without links need no join; a large component is dealt over SALT parts
    linked = of.where("component IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    alone = of.where("component IS NULL").select("node", "n_links", F.col("doc_id").alias("component_id"))
    of = written(linked.join(least, ["component", "salt"]).select("node", "n_links", "component_id").unionByName(alone), "class-components")
    out = ["doc_id", "n_shingles", "n_links", "component_id"]
    empty = docs.where("sig IS NULL").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return docs.where("sig IS NOT NULL").join(of, "node", "left").select(out).unionByName(empty)
