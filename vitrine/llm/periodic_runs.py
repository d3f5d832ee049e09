"""Periodic run detection over words: power-of-two names after Karp, Miller and Rosenberg.

Words get a name for each window of 2^k words, level by level: two windows share a name if and only if they are equal. A
period q is tried on a grid whose step is a power of two of about half of what a run must repeat: a run of period q shows as
an equal pair of named windows q apart at some grid point. From there it is extended both ways by descending levels of
names, so nothing is hashed and no suffixes are sorted. Every task handles its own texts; there is no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vitrine.llm.common import slices

#: Words that a run has at least; it also has two periods at least.
MIN_LENGTH = 12
#: Words of texts of like length that numpy handles together; a longer text goes alone.
TOGETHER = 1 << 17


def named(codes: np.ndarray, top: int, pad: int) -> list[np.ndarray]:
    """Names of the windows of 2^0, 2^1, ... 2^top words from each position, ``pad`` positions beyond the end included.

    ``codes``: equal words have equal codes below ``len(codes)``; a negative one is unlike all others. A window that stands
    once is named by its place, from ``len(codes)`` on, and so are all that hold it; only the others are ranked on the
    next level. Levels on which every window stands once are left out."""
    n = len(codes)
    place = np.arange(n, 2 * n + pad, dtype=np.int64 if n + pad > 1 << 29 else np.int32)
    often = np.bincount(codes[codes >= 0], minlength=1) > 1
    level = place.copy()
    again = np.flatnonzero((codes >= 0) & often[codes])
    level[again] = codes[again]
    levels = []
    while len(again):
        levels.append(level)
        if len(levels) > top:
            break
        step = 1 << (len(levels) - 1)
        at = again[level[again + step] < n]
        _, rank, count = np.unique(level[at].astype(np.int64) * n + level[at + step], return_inverse=True, return_counts=True)
        more = count[rank] > 1
        again = at[more]
        level = place.copy()
        level[again] = rank[more]
    return levels


def extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """For each pair how many words from ``i`` on equal those from ``j`` on, or with ``back`` those before them.

    One step down the levels each: what is left is always shorter than the window last tried."""
    size, sign = np.zeros(len(i), np.int64), -1 if back else 1
    for k in range(len(levels) - 1, -1, -1):
        off = size * sign - ((1 << k) if back else 0)
        size += (levels[k][i + off] == levels[k][j + off]) * (1 << k)
    return size


def grid(least: int, most: int, minimum: int) -> Iterator[tuple[int, int, int]]:
    """(k, first, last): periods from ``least`` to ``most`` whose repeated stretch must cover a window of 2^k on the grid of 2^k."""
    level = lambda q: (max(minimum - q, q) + 1).bit_length() - 2  # noqa: E731  2^(k+1) - 1 words hold one
    first = least
    while first <= most:
        k, last = level(first), first
        # beyond the minimum the level only changes at powers of two
        while last < most and level(last + 1) == k:
            last = min(most, max(last + 1, (1 << (k + 2)) - 2 if last >= minimum else last + 1))
        yield max(k, 0), first, last
        first = last + 1


def runs_of(codes: np.ndarray, longest: int, minimum: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the runs, by start and period. ``codes`` are those of texts of at most ``longest`` words,
    each followed by a negative one."""
    none = np.zeros(0, np.int64)
    top, pad = max(longest, 1).bit_length() - 1, 2 * longest + 2
    levels = named(codes, top, pad)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k, first, last in grid(1, longest // 2, minimum):
        if k >= len(levels):
            break
        level, n = levels[k], len(codes)
        left = level[: n : 1 << k]
        rows = np.flatnonzero(left < n)
        apart = np.lib.stride_tricks.as_strided(level[first:], (len(left), last - first + 1), (level.itemsize << k, level.itemsize), writeable=False)
        equal = apart[rows] == left[rows, None]
        begins = equal.copy()  # the first grid point of each stretch
        begins[1:] &= ~(equal[:-1] & (np.diff(rows) == 1)[:, None])
        r, c = np.nonzero(begins)
        found.append((rows[r] << k, c + first))
    if not found:
        return none, none, none
    i, q = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    start = i - extended(levels, i, i + q, back=True)
    end = i + q + extended(levels, i, i + q)
    good = end - start >= np.maximum(minimum, 2 * q)
    start, end, q = start[good], end[good], q[good]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    # multiples of a period give the same stretch
    smallest = np.ones(len(q), bool)
    smallest[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, q = start[smallest], end[smallest], q[smallest]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and where each text's begin (and the last one's end)."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = words.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    at = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    begin = at[words.offsets.to_numpy() - words.offsets[0].as_py()] if len(texts) else np.zeros(1, np.int64)
    return flat.filter(full), begin


def text_runs(codes: np.ndarray, begin: np.ndarray, minimum: int = MIN_LENGTH, together: int = TOGETHER) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of each run of many texts, by text, start and period. Texts of like length go together."""
    size = np.diff(begin)
    order = np.flatnonzero(size >= minimum)
    order = order[np.argsort(size[order], kind="stable")]
    kind = np.frexp(size[order].astype(np.float64))[1]
    full = np.cumsum(size[order] + 1)
    out, a = [np.zeros((4, 0), np.int64)], 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(full, (full[a - 1] if a else 0) + together, "right")))
        b = min(b, int(np.searchsorted(kind, kind[a], "right")))
        docs, n = order[a:b], size[order[a:b]]
        at = np.concatenate(([0], np.cumsum(n + 1)))
        where = np.repeat(begin[docs] - at[:-1], n + 1) + np.arange(at[-1])
        ends = at[1:] - 1
        where[ends] = 0
        _, local = np.unique(codes[where], return_inverse=True)
        local[ends] = -1
        start, end, q = runs_of(local, int(n[-1]), minimum)
        d = np.searchsorted(at, start, "right") - 1
        out.append(np.stack([docs[d], start - at[d], end - start, q]))
        a = b
    found = np.concatenate(out, axis=1)
    return tuple(found[:, np.lexsort((found[3], found[1], found[0]))])


def find(docs: DataFrame, minimum: int = MIN_LENGTH) -> DataFrame:
    """Runs of ``docs`` (``doc_id``, ``text``): rows ``doc_id, n_words, runs, collapsed``.

    Words are what stands between space and tab to carriage return; case and everything else counts. A run is a stretch
    of at least ``minimum`` words and two of its smallest period, as long as it goes: ``runs`` has ``start`` (word number
    from 0), ``length`` and ``period``, by start and period. ``collapsed`` is the text without the words that any run
    repeats, that is those after its first period, joined by one space. A null or empty text has no words and no runs, and a
    null text stays null; repeated rows are handled each; an empty table gives no rows; further columns are ignored. A
    task holds the texts of one slice, and for each word of what numpy handles together a number for each level."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                words, begin = split(text)
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                doc, start, length, period = text_runs(codes, begin, minimum)
                cut = np.zeros(len(words) + 1, np.int32)
                np.add.at(cut, begin[doc] + start + period, 1)
                np.add.at(cut, begin[doc] + start + length, -1)
                keep = np.cumsum(cut[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(keep)))[begin]
                kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep)))
                collapsed = pc.if_else(text.is_valid(), pc.binary_join(kept, " "), pa.scalar(None, pa.string()))
                of = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                found = pa.ListArray.from_arrays(of, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(begin), pa.int64()), found, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
