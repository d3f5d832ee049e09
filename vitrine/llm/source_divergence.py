"""Source divergence audit: how far the term shares of the sources of a language lie apart, and by which terms.

Baseline-correction inverted index. The distance of two sources is a sum over all kept terms, of which most have a count of
zero in most sources. So each pair starts at V times the distance of zero counts; what the postings of terms add is the
corrections that aren't zero: those of a term that one of both has, which depend on its count alone and are added up by
count, and those of a term that both have, which come from the term's postings, blocks of sources against blocks of sources.
All arithmetic is on integers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import forget, slices, written

#: Documents of a language that hold a kept term; units of a share; what is added to each count.
MIN_DOCS, UNITS, ADDED = 30, 1_000_000_000, 5
#: Distinct (language, source, term) of which a task keeps counts, at most, before it sends them on. This changes no result.
KEPT_COUNTS = 400_000
#: Bytes of a text whose terms are listed at a time.
LONG = 4 << 20
#: Sources of a block; a row of a term has the postings of a block at most.
BLOCK = 64
#: Pairs of postings that numpy handles at a time.
PAIRS = 1 << 20
#: Bytes as they stand in terms: A-Z lower-cased, a-z and whatever isn't ASCII as it is, blanks for the rest.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text; a very long one comes in parts that end between words."""
    plain, a = text.translate(_BYTES), 0
    while a < len(plain):
        b = plain.find(b" ", a + LONG) if len(plain) - a > LONG else -1
        b = len(plain) if b < 0 else b
        yield plain[a:b].split()
        a = b


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, added up within a task as far as its memory goes; and a
    row with a null term for each group of documents, with terms or without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for (lang, source), (n, d) in groups.items():
                terms = pa.array([*n, None], pa.binary()).cast(pa.string())
                size = len(terms)
                same = [pa.array([x] * size, pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, terms, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(d.__getitem__, n), 0], pa.int64())], ["lang", "source", "term", "n", "docs"])
            groups.clear()
            held = 0

        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary())
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts):
                    n, d = groups.get((lang, source)) or groups.setdefault((lang, source), (Counter(), Counter()))
                    before = len(n)
                    found = Counter()
                    for words in _words(text.as_py() or b""):
                        found.update(words)
                    n.update(found)
                    d.update(found.keys())
                    held += len(n) - before
                    if held > KEPT_COUNTS:
                        yield from sent()
        yield from sent()

    names = ["lang", "source", "text"]
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column | str, total: Column | str, terms: Column | str, added: int = ADDED, units: int = UNITS) -> Column:
    """1 + floor(units * (count + added) / (total + added * terms)), exact whatever the counts; null without terms."""
    c, t, v = (F.col(x) if isinstance(x, str) else x for x in (count, total, terms))
    top = F.lit(units).cast("decimal(12,0)") * (c + F.lit(added)).cast("decimal(20,0)")
    down = F.when(v > 0, (t + F.lit(added) * v).cast("decimal(20,0)"))
    # the remainder goes first, so the division has no fraction to round
    return F.lit(1).cast("long") + ((top - top % down) / down).cast("long")


def both_held(lists: DataFrame) -> DataFrame:
    """``lang, a, b, correction`` of source numbers a < b, from rows ``lang, x, y`` with the postings of a term in two blocks.

    What a term of both adds is the distance of its shares, less what stands there already: the distances of each to the
    other's zero count, and not twice the one of both zero counts. Sums stay below twice the units, so doubles hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column("lang").dictionary_encode()
            of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            sides = []
            for c in ("x", "y"):
                lists_ = batch.column(c)
                flat = lists_.flatten()
                sides.append((lists_.offsets.to_numpy().astype(np.int64) - lists_.offsets[0].as_py(), *(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))))
            (xo, xi, xp, xz), (yo, yi, yp, yz) = sides
            nx, ny = np.diff(xo), np.diff(yo)
            wide = 1 + int(max(xi.max(initial=0), yi.max(initial=0)))
            ends, total, row = np.cumsum(nx * ny), {}, 0
            while row < batch.num_rows:
                to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, "right")))
                rows = np.arange(row, to)
                each = nx[rows] * ny[rows]
                r = np.repeat(rows, each)
                k = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each)
                x, y = xo[r] + k // ny[r], yo[r] + k % ny[r]
                less = xi[x] < yi[y]
                x, y, r = x[less], y[less], r[less]
                add = np.abs(xp[x] - yp[y]) - np.abs(xp[x] - yz[y]) - np.abs(xz[x] - yp[y]) + np.abs(xz[x] - yz[y])
                keys, inv = np.unique((of[r] * wide + xi[x]) * wide + yi[y], return_inverse=True)
                for key, s in zip(keys.tolist(), np.bincount(inv, add, len(keys)).astype(np.int64).tolist()):
                    total[key] = total.get(key, 0) + s
                row = to
            key = np.fromiter(total, np.int64, len(total))
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(key // wide // wide)), pa.array(key // wide % wide), pa.array(key % wide), pa.array(np.fromiter(total.values(), np.int64, len(total)))], ["lang", "a", "b", "correction"]
            )

    return lists.mapInArrow(run, "lang string, a long, b long, correction long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = 50) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank`` for each (lang, source) of ``docs`` (``lang, source, text``; null: '').

    A term is a run of letters a-z and of what isn't ASCII, A-Z lower-cased; a language keeps the terms of at least
    ``min_docs`` of its rows. A count's share is ``share``: of a group, or of the whole language. Part ``pair``: every other source
    of the language, the distance of their shares over all kept terms; part ``term``: the ``top`` terms that a group has
    more of than its language, and by how much. Ranks count from 1 by value, greatest first, then by item. Groups without
    terms take part with counts of zero; where no term is kept, distances are 0. Repeated rows count each; a language
    with one source has no pairs; an empty table gives no rows; further columns are ignored."""
    counts = written(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    held = written(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "postings")
    # one row a language, and one a source
    total = held.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("all_total"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(total, "lang", "left")
    zero = F.coalesce("total", F.lit(0)), F.coalesce("v", F.lit(0))
    groups = groups.select("lang", "source", number.alias("k"), zero[0].alias("total"), zero[1].alias("v"), "all_total", share(F.lit(0), *zero).alias("zero"))
    groups = written(groups, "groups")
    shares = held.join(groups, ["lang", "source"])
    shares = written(shares.select("lang", "source", "k", "term", "zero", share("n", "total", "v").alias("p"), share("all_n", "all_total", "v").alias("q")), "shares")
    forget(counts)
    forget(held)

    # what is in one of both: by count, of which a source has few different ones
    alike = shares.groupBy("lang", "k", "zero", "p").agg(F.count("*").alias("terms"))
    other = groups.select("lang", F.col("k").alias("b"), F.col("zero").alias("z"))
    one = alike.join(other, "lang").where("k <> b")
    one = one.select("lang", F.least("k", "b").alias("a"), F.greatest("k", "b").alias("b"), (F.col("terms") * (F.abs(F.col("p") - F.col("z")) - F.abs(F.col("zero") - F.col("z")))).alias("correction"))
    one = one.groupBy("lang", "a", "b").agg(F.sum("correction").alias("correction"))
    # what is in both: lists of at most BLOCK postings of a term
    lists = shares.groupBy("lang", "term", (F.col("k") / BLOCK).cast("long").alias("block")).agg(F.collect_list(F.struct("k", "p", "zero")).alias("x"))
    lists = written(lists, "blocks")
    pair = lists.join(lists.select("lang", "term", F.col("block").alias("_b"), F.col("x").alias("y")), ["lang", "term"]).where("block <= _b")
    two = both_held(pair.select("lang", "x", "y"))

    corrections = one.unionByName(two).groupBy("lang", "a", "b").agg(F.sum("correction").alias("correction"))
    mine = groups.select("lang", F.col("k").alias("a"), F.col("source").alias("sa"), "v", F.col("zero").alias("za"))
    pairs = mine.join(other.join(groups.select("lang", F.col("k").alias("b"), F.col("source").alias("sb")), ["lang", "b"]), "lang").where("a < b")
    value = F.col("v") * F.abs(F.col("za") - F.col("z")) + F.coalesce("correction", F.lit(0))
    pairs = written(pairs.join(corrections, ["lang", "a", "b"], "left").select("lang", "sa", "sb", F.coalesce(value, F.lit(0)).cast("long").alias("value")), "pairs")
    forget(lists)
    both = pairs.select("lang", F.col("sa").alias("source"), F.col("sb").alias("item"), "value").unionByName(pairs.select("lang", F.col("sb").alias("source"), F.col("sa").alias("item"), "value"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = both.withColumn("rank", rank).withColumn("part", F.lit("pair"))
    out = out.unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
