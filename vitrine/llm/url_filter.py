"""URL filters: a memory-mapped sorted array of 64-bit xxhash keys, probed with binary search and confirmed by string."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules and listed strings that the array may hold (about 100 bytes each); a longer list goes through ``judge_by_join``.
MAX_ENTRIES = 2_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``,
    ``#`` or the end. Null or without ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


class DigestArray:
    """Sorted keys, their verdicts and full strings, in one file that tasks memory-map.

    An entry ``host/path`` covers the host, its subdomains and every path that starts with its path. The file holds
    64-bit numbers: three counts, the keys, the ends of the strings, the verdicts and the distinct path lengths; then the strings."""

    @staticmethod
    def write(entries: Iterable[tuple[str, str]], file: str) -> None:
        import xxhash

        split = {"".join(split_rule(r)): (v, len(split_rule(r)[1])) for r, v in entries}
        if len(split) > MAX_ENTRIES:
            raise ValueError(f"{len(split)} entries; the array holds {MAX_ENTRIES}: use judge_by_join")
        rows = sorted((xxhash.xxh64_intdigest(r), r.encode(), v == "allow") for r, (v, _) in split.items())
        lengths = sorted({n for _, n in split.values()})
        text = b"".join(r[1] for r in rows)
        parts = ([len(rows), len(lengths), len(text)], [r[0] for r in rows], np.cumsum([len(r[1]) for r in rows]), [r[2] for r in rows], lengths)
        with open(file, "wb") as out:
            out.write(b"".join(np.array(p, np.uint64).tobytes() for p in parts) + text)

    def __init__(self, file: str):
        numbers = np.memmap(file, np.uint8, "r")
        n, m, _ = numbers[:24].view(np.uint64).tolist()
        cut = lambda a, k: numbers[8 * a : 8 * (a + k)].view(np.uint64)
        self.keys, self.ends, self.allow, self.lengths = cut(3, n), cut(3 + n, n), cut(3 + 2 * n, n), cut(3 + 3 * n, m)
        self.text = numbers[8 * (3 + 3 * n + m) :]

    def entry(self, k: int) -> bytes:
        return self.text[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes()

    def find(self, probes: list[str]) -> np.ndarray:
        """Position of each string, -1 where it isn't listed. Equal digests are told apart by their strings."""
        import xxhash

        want = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, want)
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys):
            return out
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want).tolist():
            k, text = int(at[i]), None
            while k < len(self.keys) and self.keys[k] == want[i]:
                text = text if text is not None else probes[i].encode()
                if self.entry(k) == text:
                    out[i] = k
                    break
                k += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """The longest entry (host and path together; then the longer host) that fits, with its verdict."""
        probes, owner, best = [], [], [None] * len(hosts)
        lengths = self.lengths.tolist()
        for i, (h, p) in enumerate(zip(hosts, paths)):
            labels = h.split(".")
            for k in range(len(labels) if h else 0):
                suffix = ".".join(labels[k:])
                for n in lengths:
                    if n <= len(p):
                        probes.append(suffix + p[:n])
                        owner.append((i, len(suffix)))
        where = self.find(probes)
        for j in np.flatnonzero(where >= 0).tolist():
            i, n = owner[j]
            rank = (len(probes[j]), n, probes[j], bool(self.allow[where[j]]))
            best[i] = max(best[i] or rank, rank)
        return [b and (b[2], "allow" if b[3] else "block") for b in best]


def publish(spark: SparkSession, entries: Iterable[tuple[str, str]]) -> str:
    """Build the array on the driver and hand it to every executor as a job file; returns the file's name there."""
    handle, file = tempfile.mkstemp(prefix="digests-")
    os.close(handle)
    DigestArray.write(entries, file)
    spark.sparkContext.addFile(file)
    return os.path.basename(file)


_open: dict[str, DigestArray] = {}


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], listed: Iterable[str] = (), url: str = "url", key: str = "page_id") -> DataFrame:
    """Judge URLs: ``key, host, path, rule, verdict``.

    ``rules`` are (``host/path``, allow or block); ``listed`` are hosts or host/path strings that are blocked where no
    rule fits, by the same probing; anything else is allowed. Null, empty and odd URLs have an empty host and are
    allowed. Repeated rows are judged each; an empty table gives no rows; further columns are ignored."""
    spark = pages.sparkSession
    ruled, more = publish(spark, rules), publish(spark, ((x, "block") for x in listed))
    host, path = host_and_path(F.col("url"))
    kind = dict(pages.dtypes)[key]
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = []
        for name in (ruled, more):
            if name not in _open:
                _open[name] = DigestArray(SparkFiles.get(name))
            arrays.append(_open[name])
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            by_rule, by_list = (a.judge(hosts, paths) for a in arrays)
            rule = [r and r[0] for r in by_rule]
            verdict = [r[1] if r else (x[1] if x else "allow") for r, x in zip(by_rule, by_list)]
            hit = [x and x[0] for x in by_list]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(hit, pa.string())], [key, "host", "path", "rule", "verdict", "listed"])

    return rows.mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string, listed string")


def judge_by_join(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """As ``judge``, for lists of any size: the same probes as rows, joined by string to ``rules`` (``entry``, ``verdict``)
    and ``listed`` (``entry``). Each different host and path is probed once."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    every = rules.select("entry", "verdict", F.lit(1).alias("rank")).unionByName(listed.select("entry", F.lit("block").alias("verdict"), F.lit(0).alias("rank")))
    parts = every.select(lower(F.split_part("entry", F.lit("/"), F.lit(1))).alias("s"), F.regexp_extract("entry", "(?s)/.*", 0).alias("q"), "verdict", "rank")
    # an entry that stands twice: the last verdict by name, allow before block, as in the array's order of ranks
    parts = parts.groupBy("s", "q", "rank").agg(F.min("verdict").alias("verdict"))
    lengths = sorted(r["n"] for r in parts.select(F.length("q").alias("n")).distinct().collect())  # as many as the longest path has characters
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    probes = rows.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("s"), fits.alias("_n"))
    probes = probes.select("host", "path", "s", F.explode(F.transform("_n", lambda n: F.substring("path", F.lit(1), n))).alias("q"))
    found = probes.join(parts, ["s", "q"])
    best = lambda r: F.max(F.when(F.col("rank") == r, F.struct(F.length(F.concat("s", "q")).alias("n"), F.length("s").alias("m"), F.concat("s", "q").alias("entry"), "verdict")))
    best = found.groupBy("host", "path").agg(best(1).alias("r"), best(0).alias("l"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(F.col("key").alias(key), "host", "path", F.col("r.entry").alias("rule"), F.coalesce("r.verdict", "l.verdict", F.lit("allow")).alias("verdict"), F.col("l.entry").alias("listed"))
