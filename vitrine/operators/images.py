"""Pictures of a profile: files in, vectors and traits out; and what is left when one goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import constants as K
from vitrine.operators import recommend
from vitrine.operators.encoders import Encoder

#: Bytes of a picture's file, at most; a longer one is refused.
MAX_BYTES = 15_000_000
# fixed values: how the files of picture formats begin
MAGIC = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "gif": "47494638", "bmp": "424D", "webp": "52494646........57454250"}
#: Letters of a picture's id.
ID_LENGTH = 10


def kind_of(content: Column | str) -> Column:
    """The format by the first bytes; null if it is none of MAGIC."""
    head = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 12))
    return F.coalesce(*[F.when(head.rlike(f"^{m}"), name) for name, m in MAGIC.items()])


def files(spark: SparkSession, path: str) -> DataFrame:
    """Pictures under ``path`` (``<pid>/<name>``): ``pid, name, image_id, kind, error, content``. ``error`` is ``too large`` or ``no picture``, else null;
    content beside an error is null. The id is made of the content, so a picture that comes twice is one."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    d = f.select(F.url_decode(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("pid"), name.alias("name"), "length", "content")
    d = d.withColumn("kind", kind_of("content")).withColumn("error", F.when(F.col("length") > MAX_BYTES, "too large").when(F.col("kind").isNull(), "no picture"))
    return d.select("pid", "name", F.left(F.sha1("content"), F.lit(ID_LENGTH)).alias("image_id"), "kind", "error", F.when(F.col("error").isNull(), F.col("content")).alias("content"))


def encoded_images(content: Column, encoder: Encoder) -> Column:
    """A vector per picture, in Arrow batches; null for null and for what the encoder can't read."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = [c for c in s if c is not None]
            vecs = iter(encoder.images(known) if known else [])
            found = [None if c is None else next(vecs) for c in s]
            yield pd.Series([None if v is None else np.asarray(v, np.float32).tolist() for v in found], dtype=object)

    return run(content)


def ingested(pictures: DataFrame, encoder: Encoder) -> DataFrame:
    """``pid, image_id, name, vec, error`` of ``pictures`` (as from ``files``): one row for each profile and picture, the first by name.
    ``error`` is also ``unreadable``, where the encoder says so."""
    one = pictures.groupBy("pid", "image_id").agg(F.min_by(F.struct("name", "error", "content"), "name").alias("p"))
    d = one.select("pid", "image_id", "p.*").withColumn("vec", encoded_images(F.col("content"), encoder)).drop("content")
    return d.withColumn("error", F.coalesce("error", F.when(F.col("vec").isNull(), "unreadable"))).select("pid", "image_id", "name", "vec", "error")


def read_traits(images: DataFrame, vocabulary: DataFrame, kind: str = "image") -> DataFrame:
    """Traits that pictures show (``pid, image_id, vec``): ``pid, text, n_images, score, sources``.

    Of each profile's phrases nearest to any of its pictures, those on most pictures and then by score, VOCAB_MAX at most; a
    phrase's sources are the pictures that show it. The ``vocabulary`` (``phrase, q``) is a list of hand-kept size."""
    hits = recommend.nearest_phrases(images, vocabulary, "pid", "image_id")
    by = hits.groupBy("pid", "phrase").agg(F.count("*").alias("n_images"), F.sum("z").alias("score"), F.array_sort(F.collect_set("image_id")).alias("_i"))
    # a profile's phrases are at most the vocabulary's
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n_images")).alias("a"), (-F.col("score")).alias("b"), F.col("phrase").alias("text"), "n_images", "score", "_i"))), 1, K.VOCAB_MAX)
    out = by.groupBy("pid").agg(top.alias("_t")).select("pid", F.explode("_t").alias("t"))
    sources = F.transform("t._i", lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("ref")))
    return out.select("pid", "t.text", "t.n_images", "t.score", sources.alias("sources"))


def merged(traits: DataFrame, new: DataFrame) -> DataFrame:
    """Merge ``new`` (``pid, text, sources``) into traits (``pid, text, sources, user_added``): sources that a text lacks are added after
    those that it has, unknown texts become traits."""
    d = traits.withColumn("_k", F.lit(0)).unionByName(new.select("pid", "text", "sources", F.lit(False).alias("user_added"), F.lit(1).alias("_k")))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("_k", "sources"))), lambda s: s["sources"])
    return d.groupBy("pid", "text").agg(F.array_distinct(F.flatten(lists)).alias("sources"), F.max("user_added").alias("user_added"))


def removed(images: DataFrame, traits: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and traits without the sources ``gone`` (``pid, kind, ref``): pictures of kinds ``image`` and ``pin`` go, every trait forgets
    them, and traits left without a source go too, unless a user added them."""
    out = gone.select("pid", "kind", "ref").distinct()
    pictures = images.join(out.where(F.col("kind").isin("image", "pin")).select("pid", F.col("ref").alias("image_id")), ["pid", "image_id"], "left_anti")
    # what goes of a profile, beside its traits: as many rows as its pictures at most
    listed = out.groupBy("pid").agg(F.collect_list(F.struct("kind", "ref")).alias("_g"))
    d = traits.join(listed, "pid", "left").withColumn("sources", F.when(F.col("_g").isNull(), F.col("sources")).otherwise(F.array_except("sources", "_g"))).drop("_g")
    return pictures, d.where((F.size("sources") > 0) | F.col("user_added"))


def trait_sources(events: DataFrame) -> DataFrame:
    """Traits by replaying a log ``event_id, ts, pid, action, kind, ref, text``: ``add`` gives a text a source, ``remove`` takes a source from all
    texts, ``keep`` makes a text the user's own. Rows ``pid, text, sources, user_added``, sources in the order in which they came.

    A source stands if it was added after its last removal; that is told by two aggregations and a join on the source."""
    at = F.struct("ts", "event_id")
    gone = events.where("action = 'remove'").groupBy("pid", "kind", "ref").agg(F.max(at).alias("_gone"))
    adds = events.where("action = 'add'").join(gone, ["pid", "kind", "ref"], "left").where(F.col("_gone").isNull() | (at > F.col("_gone")))
    first = adds.groupBy("pid", "text", "kind", "ref").agg(F.min(at).alias("_at"))
    rows = first.select("pid", "text", F.struct("_at", "kind", "ref").alias("s"), F.lit(False).alias("own"))
    own = events.where("action = 'keep'").select("pid", "text", F.lit(None).cast(rows.schema["s"].dataType).alias("s"), F.lit(True).alias("own")).distinct()
    d = rows.unionByName(own).groupBy("pid", "text").agg(F.array_sort(F.collect_list("s")).alias("_s"), F.max("own").alias("user_added"))
    return d.select("pid", "text", F.transform("_s", lambda s: F.struct(s["kind"].alias("kind"), s["ref"].alias("ref"))).alias("sources"), "user_added")
