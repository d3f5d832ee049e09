"""Substring dedup: MinHash banding of paragraphs cut by content.

Repeated passages start and end anywhere, so paragraphs are cut where the words say so: after each word whose hash is the
smallest among its neighbours on either side. A passage is then cut alike in every document, but for its ends. Equal
paragraphs are one; distinct ones that collide in a band of MinHashes are joined, verified by the exact Jaccard similarity
of their shingles or, as one changed word changes five shingles, for short ones by the edit distance of their words, and
clustered by connected components. In keys of three or more only pairs that share one of their rarest shingles are
compared, which leaves out no similar one. The first paragraph of a cluster stays, the others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import components, fresh, mix, rolled, slices, word_hashes, written

#: A cut is the minimum of the REACH hashes on both sides, so paragraphs have REACH + 1 words or more, 11 on average.
REACH = 5
#: Paragraphs with fewer words are passed over.
MIN_WORDS = 7
#: Bands and rows of MinHashes: two shingle sets with similarity 0.8 collide with chance 1 - (1 - 0.8^2)^4 = 98 %; one
#: changed word in 32 leaves 0.7, which collides with 93 %. Shorter shingles would find more such pairs, but the keys of
#: frequent phrases then gather unlike paragraphs: with three words, 10 million pairs on 0.1 GB.
BANDS, ROWS = 4, 2
SHINGLE = 5
#: Paragraphs of at most SHORT words also link by edit distance, with one edit for every PER_EDIT words of the longer.
SHORT, PER_EDIT = 64, 32


def cuts(h: np.ndarray) -> np.ndarray:
    """Starts of the paragraphs of a text with word hashes ``h``, and its end."""
    n = len(h)
    if n <= 2 * REACH:
        return np.array([0, n]) if n else np.zeros(1, np.int64)
    least = np.ones(n, bool)
    least[:REACH] = least[n - REACH :] = False
    mid = h[REACH : n - REACH]
    for d in range(1, REACH + 1):  # the first of equal minima
        least[REACH : n - REACH] &= (mid < h[REACH - d : n - REACH - d]) & (mid <= h[REACH + d : n - REACH + d])
    return np.unique(np.concatenate(([0], np.flatnonzero(least) + 1, [n])))


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """As ``word_hashes``, and the starts and the end of each text's newline-delimited paragraphs."""
    lines = pc.split_pattern(texts, "\n")
    h, ends = word_hashes(lines.flatten())
    o = lines.offsets.to_numpy() - lines.offsets[0].as_py()
    return h, ends[o], [ends[a : b + 1] for a, b in zip(o, o[1:])]


def _hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run of word hashes."""
    size = last - first
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    # a running sum of mixed hashes would not see the order of words; places within the paragraph do
    place = (at - np.repeat(first, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h[at] * (2 * place + np.uint64(1))))))
        ends = np.cumsum(size)
        return mix(summed[ends] - summed[ends - size] + size.astype(np.uint64))


def _paragraphs(own: bool, banded: bool):
    """mapInArrow over (doc_id, text): each paragraph's place, words and hash, and if ``banded`` its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, own, banded)

    return run


def _cut(batches: Iterator[pa.RecordBatch], own: bool, banded: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            if own:
                h, at, spans = _lines(part.column("text"))
            else:
                h, at = word_hashes(part.column("text"))
                spans = [cuts(h[a:b]) + a for a, b in zip(at, at[1:])]
            n = np.array([len(s) - 1 for s in spans], np.int64)
            first = np.concatenate([*(s[:-1] for s in spans), np.zeros(0, np.int64)])
            last = np.concatenate([*(s[1:] for s in spans), np.zeros(0, np.int64)])
            long = last - first >= MIN_WORDS
            doc, base, first, last = np.repeat(np.arange(part.num_rows), n)[long], np.repeat(at[:-1], n)[long], first[long], last[long]
            docs = part.column("doc_id").take(pa.array(doc))
            columns = [docs, pa.array((first - base).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(_hashes(h, first, last).view(np.int64))]
            if banded:
                starts = np.stack([first, last - SHINGLE + 1], 1).ravel()
                keys = np.zeros((BANDS, len(first)), np.uint64)
                with np.errstate(over="ignore"):
                    windows = rolled(h, SHINGLE)
                    for b in range(BANDS):
                        for r in range(ROWS):
                            mixed = mix(windows ^ mix(np.uint64([97 * b + r + 1])))
                            low = np.minimum.reduceat(np.append(mixed, np.uint64(2**64 - 1)), starts)[::2] if len(starts) else mixed[:0]
                            keys[b] = mix(keys[b] ^ low)
                keys = np.ascontiguousarray(keys.T).ravel()
                offsets = pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "words", "h", "bands"][: len(columns)])


def edits(a: list, b: list, most: int) -> int:
    """The edit distance of two lists of words, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def similar(a: list, b: list, percent: int) -> bool:
    """Whether the five-word shingles of two word lists reach the Jaccard similarity, or, if both are short, their words
    are at most one edit for every PER_EDIT words apart."""
    x, y = ({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for w in (a, b))
    if 100 * len(x & y) >= percent * len(x | y):
        return True
    most = max(len(a), len(b)) // PER_EDIT
    return most > 0 and max(len(a), len(b)) <= SHORT and edits(a, b, most) <= most


def _verify(percent: int):
    """mapInArrow over (a, b, words_a, words_b): pairs of hashes whose words reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(x.split(" "), y.split(" "), percent) for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (text, want): the words of the wanted paragraphs, by hash; of an id's several texts, those that have it."""
    for batch in batches:
        out = []
        for i, want in enumerate(batch.column("want").to_pylist()):
            text = batch.column("text").slice(i, 1)
            h, words = word_hashes(text)[0], text[0].as_py().encode().lower().split()
            first = np.array([w["start"] for w in want], np.int64)
            last = first + np.array([w["words"] for w in want], np.int64)
            there = last <= len(h)
            same = np.zeros(len(want), bool)
            same[there] = _hashes(h, first[there], last[there]).view(np.int64) == np.array([w["h"] for w in want], np.int64)[there]
            out += [(want[k]["h"], b" ".join(words[first[k] : last[k]]).decode()) for k in np.flatnonzero(same).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["h", "w"])


def _verified(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose ``words`` (``h``, ``w``) reach the similarity."""
    a, b = (words.select(F.col("h").alias(c), F.col("w").alias(f"w{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "wa", "wb").mapInArrow(_verify(percent), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (h, w): the number of words and the distinct shingles of each paragraph."""
    for batch in batches:
        for part in slices(batch, "w"):
            h, at = word_hashes(part.column("w"))
            windows = rolled(h, SHINGLE).view(np.int64)
            sets = [np.unique(windows[a : max(a, b - SHINGLE + 1)]) for a, b in zip(at, at[1:])]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            shingles = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(np.diff(at).astype(np.int32)), shingles], ["h", "words", "shingles"])


def _most(words: Column) -> Column:
    """The edits that a paragraph may be from another one, which may have more words."""
    longest = [max((m // PER_EDIT for m in range(n, SHORT + 1) if m - n <= m // PER_EDIT), default=0) for n in range(SHORT + 1)]
    return F.coalesce(F.get(F.array(*map(F.lit, longest)), words), F.lit(0))


def _rest(sets: DataFrame, links: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that join, with ``links``, all similar pairs of ``sets`` (``h``, ``words``, ``shingles``).

    With shingles in one order for all, a similar pair shares one among the first of both: as many as one may lack of the
    other's, and one more. An edit changes SHINGLE of them. The order is by frequency, so what unlike paragraphs have in
    common comes last and few pairs meet. Equal sets are linked to their first; pairs that are joined already are passed over."""
    same = sets.withColumn("low", F.min("h").over(Window.partitionBy("shingles"))).where("h <> low").select(F.col("h").alias("a"), F.col("low").alias("b"))
    same = written(same, "equal-sets")
    joined = components(links.unionByName(same)).withColumnRenamed("node", "h")
    each = sets.select("h", F.explode("shingles").alias("x"))
    often = each.groupBy("x").agg(F.count("*").alias("n")).where("n > 1")
    order = each.join(often, "x", "left").groupBy("h").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "x"))).alias("o"))
    rows = order.join(sets.select("h", "words"), "h").join(joined, "h", "left").withColumns({"m": F.size("o"), "c": F.coalesce("component", "h")})
    lacks = F.greatest(F.floor(F.col("m") * (100 - percent) / 100), SHINGLE * _most(F.col("words")))
    first = rows.select("h", "words", "m", "c", F.posexplode(F.slice("o", F.lit(1), (lacks + 1).cast("int"))).alias("i", "s")).where("s.n > 1")
    first = written(first.select(F.col("s.x").alias("x"), "h", "words", "m", "c", "i"), "rarest")
    a, b = (first.select("x", *(F.col(k).alias(k + side) for k in ("h", "words", "m", "c", "i"))) for side in "ab")
    # the first shingle that both have: what stands before it the other one lacks
    both, longer = F.least(F.col("ma") - F.col("ia"), F.col("mb") - F.col("ib")), F.greatest("wordsa", "wordsb")
    edit = F.floor(longer / PER_EDIT)
    near = (longer <= SHORT) & (edit > 0) & (F.abs(F.col("wordsa") - F.col("wordsb")) <= edit) & (F.greatest("ia", "ib") <= SHINGLE * edit)
    may = (100 * both >= percent * (F.col("ma") + F.col("mb") - both)) | near
    pairs = a.join(b, "x").where((F.col("ha") > F.col("hb")) & (F.col("ca") != F.col("cb")) & may).select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct()
    return same.unionByName(_verified(pairs, words, percent))


def repeats(docs: DataFrame, percent: int = 80, own: bool = False) -> DataFrame:
    """Repeated passages of ``docs`` (``doc_id`` long, ``text``).

    Paragraphs are cut by content, or with ``own`` are the text's own newline-delimited ones, banded and verified whole.
    One row per paragraph whose cluster has more than one: ``doc_id``, ``start`` and ``words`` (its place in the
    document's sequence of words), ``cluster_id`` (a hash) and ``kept`` (true for the cluster's first, by id and place).
    Words are runs of non-white-space, A-Z lower-cased; paragraphs under MIN_WORDS words are passed over, so documents with
    fewer words, null or empty texts give no rows. Rows with a null id take no part; repeated rows repeat their
    passages, and one of them is kept. Further columns are ignored; an empty table gives no rows. Equal paragraphs are
    always found, similar ones with the chance of the bands: whatever shares a key is compared, or joined through others."""
    text = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = "doc_id long, start int, words int, h long"
    paragraphs = text.mapInArrow(_paragraphs(own, True), f"{made}, bands array<long>")
    units = paragraphs.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "words")).alias("at"), F.first("bands").alias("bands"))
    units = written(units, "units")

    # each unit meets the first of its key; what similar pairs a key of three or more still holds, their rarest shingles tell
    key = Window.partitionBy("key")
    keys = units.select("h", F.explode("bands").alias("key"))
    met = keys.select("h", F.min("h").over(key).alias("low"), F.max("h").over(key).alias("high"), F.count("*").over(key).alias("n")).where("low <> high")
    met = written(met.groupBy("h", "low").agg(F.max("n").alias("n")), "met")
    want = units.join(met.select("h").distinct(), "h").select("at.doc_id", F.struct("at.start", "at.words", "h").alias("w"))
    want = want.groupBy("doc_id").agg(F.collect_list("w").alias("want"))  # places in one document
    found = text.join(want, "doc_id").select("text", "want").mapInArrow(_texts, "h long, w string")
    words = written(found.dropDuplicates(["h"]), "met-texts")
    links = written(_verified(met.where("h <> low").select(F.col("h").alias("a"), F.col("low").alias("b")), words, percent), "links")
    sets = words.join(met.where("n > 2").select("h").distinct(), "h", "left_semi").mapInArrow(_sets, "h long, words int, shingles array<long>")
    more = _rest(written(sets, "sets"), links, words, percent)
    of = components(links.unionByName(more))

    clusters = units.select("h", "n", F.struct("at.*", "h").alias("at")).join(of.withColumnRenamed("node", "h"), "h", "left").where("n > 1 OR component IS NOT NULL")
    clusters = clusters.withColumn("cluster_id", F.coalesce("component", "h"))
    total = clusters.groupBy("cluster_id").agg(F.sum("n").alias("total"), F.min("at").alias("first")).where("total > 1")
    clusters = written(clusters.join(total, "cluster_id").select("h", "cluster_id", "first"), "clusters")
    out = text.mapInArrow(_paragraphs(own, False), made).join(clusters, "h")
    out = out.withColumn("kept", (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start")) & (F.col("h") == F.col("first.h")))
    out = written(out.select("doc_id", "start", "words", "cluster_id", "kept"), "found")
    # a repeated row repeats the first place: one of them is kept
    one = out.where("kept").groupBy("doc_id", "start", "words", "cluster_id").agg(F.count("*").alias("n"))
    one = one.select("doc_id", "start", "words", "cluster_id", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: i == 1)).alias("kept"))
    return out.where("NOT kept").unionByName(one)


def passages(found: DataFrame, min_words: int = 1) -> DataFrame:
    """Runs of adjacent repeated paragraphs: ``doc_id, start, words, n_removed`` (paragraphs that are not kept), of
    ``min_words`` words or more."""
    by = Window.partitionBy("doc_id").orderBy("start", "words")
    gap = F.coalesce(F.col("start") > F.lag(F.col("start") + F.col("words")).over(by), F.lit(True)).cast("int")
    runs = found.dropDuplicates(["doc_id", "start"]).withColumn("_new", gap).withColumn("_run", F.sum("_new").over(by))
    runs = runs.groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.sum("words").cast("int").alias("words"), F.count_if(~F.col("kept")).alias("n_removed"))
    return runs.where(F.col("words") >= min_words).drop("_run")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the words of paragraphs that are not kept cut from ``text``; documents without any are untouched."""
    names, schema, u = docs.columns, docs.schema, fresh(docs)
    gone = found.where(~F.col("kept")).groupBy(F.col("doc_id").alias(f"{u}d")).agg(F.collect_set(F.struct("start", "words")).alias(f"{u}gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column(f"{u}gone").to_pylist()):
                if spans and texts[i]:
                    drop = {k for s in spans for k in range(s["start"], s["start"] + s["words"])}
                    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", texts[i])]
                    texts[i] = texts[i][: at[0][0]] + "".join(texts[i][a:b] for k, (a, b) in enumerate(at) if k not in drop)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    d = docs.join(gone, F.col("doc_id") == F.col(f"{u}d"), "left").drop(f"{u}d")
    return d.select(*names, f"{u}gone").mapInArrow(cut, schema)
