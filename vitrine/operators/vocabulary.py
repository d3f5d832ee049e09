"""The trait vocabulary with vectors, kept up with the files that it comes from.

Its phrases stand in hand-kept files (YAML or JSON lists, text files with a JSON list on each line), its vectors in a versioned table keyed by phrase. A refresh
looks at the files' names, lengths and times of change; only if they differ are the files read, and only phrases that the
table lacks are encoded. Phrases that left the files leave the table."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import text as T
from vitrine.operators import recommend
from vitrine.operators.encoders import Encoder, encoded
from vitrine.sources import versions
from vitrine.sources.keyed import KeyedTable

#: Bytes of a hand-kept list that are parsed; a longer file is refused, not cut.
MAX_LIST = 64 << 20


def _listed(name: str, content: bytes) -> list[str]:
    if len(content) > MAX_LIST:
        raise ValueError(f"{name} has {len(content)} bytes; a phrase list has at most {MAX_LIST}")
    if name.endswith((".yaml", ".yml")):
        import yaml

        lists = [yaml.safe_load(content) or []]
    else:
        lists = [json.loads(line) for line in content.splitlines() if line.strip()] if name.endswith(".txt") else [json.loads(content or b"[]")]
    return [str(x) for found in lists for x in found]


def phrases(spark: SparkSession, *paths: str) -> DataFrame:
    """``phrase``: the cleaned, distinct phrases of all files under ``paths``; files are parsed where they are read. A path that isn't
    there has none; a file that is no list, or too long, fails the read."""

    @F.udf("array<string>")
    def parsed(name: str, content: bytes) -> list[str]:
        return _listed(name, bytes(content))

    found = spark.createDataFrame([], "phrase string")
    for p in paths:
        if versions.stamp(spark, p) == "[null]":
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
        found = found.unionByName(files.select(F.explode(T.clean_traits(parsed("path", "content"))).alias("phrase")))
    return found.distinct()


@dataclass(frozen=True)
class Refresh:
    """What a refresh did."""

    version: int
    encoded: int
    dropped: int
    read_sources: bool


class Vocabulary:
    """The vectors of the phrases of ``paths``, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, *paths: str, buckets: int = 8):
        self.spark, self.paths, self.table = spark, paths, KeyedTable(spark, root, "phrase", buckets)

    def refresh(self, encoder: Encoder) -> Refresh:
        """Bring the table up to the files. Unchanged files are not opened and nothing is encoded."""
        base = self.table.versions.manifest()
        stamp = versions.stamp(self.spark, *self.paths)
        if base.facts.get("stamp") == stamp:
            return Refresh(base.version, 0, 0, False)
        listed = phrases(self.spark, *self.paths)
        if base.version:
            old = self.table.rows()
            kept, new = old.join(listed, "phrase", "left_semi"), listed.join(old.select("phrase"), "phrase", "left_anti")
        else:
            kept, new = None, listed
        made = new.select("phrase", encoded(F.col("phrase"), encoder).alias("vec"), F.lit(base.version + 1).alias("since"))
        after = self.table.write(made if kept is None else kept.unionByName(made), {"stamp": stamp})
        n = self.table.rows().agg(F.count_if(F.col("since") == after.version), F.count("*")).first()
        before = old.count() if base.version else 0
        return Refresh(after.version, n[0], before + n[0] - n[1], True)

    def vectors(self) -> DataFrame:
        """``phrase, q``."""
        return self.table.rows().select("phrase", F.col("vec").alias("q"))

    def read(self, images: DataFrame) -> DataFrame:
        """The phrases nearest to a batch of images (``id, vec``), by the vectors as they stand."""
        return recommend.read_vocabulary(images, self.vectors())


def learn(path: str, known: DataFrame, new: DataFrame) -> int:
    """Add a reader's phrases (``phrase``) to the learned list, a folder of JSON lists: how many were new. Each call writes
    files of its own, so what is there isn't rewritten."""
    fresh = new.select(F.explode(T.clean_traits(F.array("phrase"))).alias("phrase")).distinct().join(known.select("phrase"), "phrase", "left_anti")
    n = fresh.count()
    if n:
        write_lists(fresh, path, "append")
    return n


def write_lists(words: DataFrame, path: str, mode: str) -> None:
    """Phrases as text files with a JSON list on each line."""
    few = words.groupBy(F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("_k"))
    few.agg(F.to_json(F.collect_list("phrase")).alias("value")).select("value").write.mode(mode).text(path)
