"""Encoders and trait readers behind small interfaces, so that models are inputs and never part of the engine."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import text as T


class Encoder(Protocol):
    def texts(self, texts: list[str]) -> np.ndarray:
        """Unit vectors, one row each."""

    def images(self, contents: list[bytes]) -> list[np.ndarray | None]:
        """A unit vector for each picture's file, None for one that can't be read."""


class HashEncoder:
    """Deterministic vectors from hashed words, for tests and dry runs: texts that share words are near."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def texts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                seed = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "little")
                out[i] += np.random.default_rng(seed).standard_normal(self.dim).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


    def images(self, contents: list[bytes]) -> list[np.ndarray | None]:
        """Vectors from the bytes: equal files have equal ones. A file of fewer than 16 bytes is none that could be read."""
        return [None if len(c) < 16 else self.texts([hashlib.sha1(c).hexdigest()])[0] for c in contents]


class OnnxEncoder:
    """A text model file over token ids of fixed length. The file must be readable on every worker."""

    def __init__(self, model: str, tokenizer: str, length: int = 77):
        self.model, self.tokenizer, self.length, self._made = model, tokenizer, length, None

    def texts(self, texts: list[str]) -> np.ndarray:
        if self._made is None:  # once per worker
            import onnxruntime

            self._made = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
        ids = token_ids(texts, self.tokenizer, self.length)
        out = self._made.run(None, {self._made.get_inputs()[0].name: ids})[0].astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def __getstate__(self):
        return {**self.__dict__, "_made": None}


@functools.cache
def _tokenizer(path: str):
    """Loaded once per worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def unmangled(text: str) -> str:
    """A text whose UTF-8 bytes were once read as a Western code page, as it was meant; any other stays."""
    for page in ("cp1252", "latin-1"):
        try:
            meant = text.encode(page).decode("utf-8")
        except UnicodeError:
            continue
        return unmangled(meant) if len(meant) < len(text) else text
    return text


def token_ids(texts: list[str], tokenizer: str, length: int = 77) -> np.ndarray:
    """Start id, ids and end id per text, cut to ``length`` with the end kept, padded with zeros."""
    import html

    tok = _tokenizer(tokenizer)
    start, end = tok.token_to_id("<|startoftext|>"), tok.token_to_id("<|endoftext|>")
    out = np.zeros((len(texts), length), np.int64)
    for i, e in enumerate(tok.encode_batch([html.unescape(html.unescape(unmangled(t))).strip() for t in texts], add_special_tokens=False)):
        ids = [start, *e.ids, end][:length]
        ids[-1] = end
        out[i, : len(ids)] = ids
    return out


def encoded(texts: Column, encoder: Encoder) -> Column:
    """A vector per text, in Arrow batches; null texts give null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = [t for t in s if t is not None]
            vecs = iter(encoder.texts(known) if known else [])
            yield pd.Series([None if t is None else next(vecs).tolist() for t in s], dtype=object)

    return run(texts)


class TraitReader(Protocol):
    """A paid reader. Each answer is a list of traits, or None where it can't tell."""

    def brand(self, name: str, titles: list[str], types: list[str], description: str | None) -> list[str] | None:
        """Traits of a brand by what it sells, or by what is said about it."""

    def images(self, contents: list[bytes], captions: list[str | None]) -> list[str] | None:
        """Traits that a batch of pictures shows."""

    def polish(self, candidates: list[str], titles: list[str]) -> list[str] | None:
        """Candidates in better words, beside titles of pieces that are near."""


def brand_samples(items: DataFrame, titles: int = 80, types: int = 25) -> DataFrame:
    """What a reader sees of a brand: its first titles by id and its first distinct types by name. Both are cut by rank before the
    shuffle, so a large brand is never gathered whole."""
    rows = items.select(F.lower(F.trim("brand")).alias("key"), "id", "title", "product_type")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_n") <= titles)
    first = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda s: s["title"]).alias("titles"))
    kinds = rows.where("product_type IS NOT NULL").groupBy("key", "product_type").agg(F.lit(1).alias("_one"))
    kinds = kinds.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("product_type"))).where(F.col("_n") <= types)
    kinds = kinds.groupBy("key").agg(F.array_sort(F.collect_list("product_type")).alias("types"))
    return first.join(kinds, "key", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def _answers(misses: DataFrame, columns: list[str], ask, reader: TraitReader | None) -> DataFrame:
    """``key, traits`` of rows ``key`` and ``columns``, which ``ask`` gets after the reader: cleaned answers, null without a reader or an answer."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [None if reader is None else ask(reader, *row) for row in b[["key", *columns]].itertuples(index=False, name=None)]
            yield pd.DataFrame({"key": b["key"], "traits": pd.Series([None if g is None else list(g) for g in got], dtype=object)})

    found = misses.select("key", *columns).mapInPandas(read, "key string, traits array<string>")
    return found.withColumn("traits", T.clean_traits("traits"))


def read_through(asked: DataFrame, cache: DataFrame, columns: list[str], ask, reader: TraitReader | None) -> tuple[DataFrame, DataFrame]:
    """Traits of ``asked`` (``key`` and ``columns``, a row for each key) from the cache (``key, traits``), else from the reader; and the new
    rows of the cache, those with at least one trait. Only misses reach the reader."""
    hit = asked.join(cache.select("key", "traits"), "key").select("key", "traits")
    new = _answers(asked.join(cache.select("key"), "key", "left_anti"), columns, ask, reader)
    return hit.unionByName(new), new.where(F.size("traits") > 0)


def brand_traits(names: DataFrame, cache: DataFrame, items: DataFrame, reader: TraitReader | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Traits of ``names`` (``brand``) from the cache, else from the reader, who sees samples of the brand's items, or of a brand without
    items what ``known`` (``name, description``) says, if anything; and the new cache rows. Without a reader the misses are null."""
    n = names.select(F.lower(F.trim("brand")).alias("key")).distinct().join(brand_samples(items), "key", "left")
    n = n.withColumn("description", F.lit(None).cast("string"))
    if known is not None:
        said = known.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("description").alias("_said"))
        n = n.join(said, "key", "left").withColumn("description", F.when(F.col("titles").isNull(), F.col("_said"))).drop("_said")

    def ask(r, key, titles, types, description):
        if titles is None and description is None:
            return None
        return r.brand(key, [] if titles is None else list(titles), [] if types is None else list(types), description)

    return read_through(n, cache, ["titles", "types", "description"], ask, reader)


#: Pictures that a reader sees at a time.
BATCH = 8


def image_batches(pictures: DataFrame, by: str = "pid", order: str = "n", size: int = BATCH) -> DataFrame:
    """Batches of ``pictures`` (``by``, ``order``, ``content``) of ``size`` at most, as ``by, batch, key, contents, captions``: ``key`` is the hash of the
    pictures' hashes in their order, so equal batches have equal keys. ``order`` counts a profile's pictures from 0. ``caption`` is optional."""
    caption = F.col("caption") if "caption" in pictures.columns else F.lit(None).cast("string")
    one = F.struct(F.col(order).alias("n"), F.sha1("content").alias("h"), F.col("content").alias("content"), caption.alias("caption"))
    d = pictures.groupBy(by, F.floor(F.col(order) / size).cast("long").alias("batch")).agg(F.array_sort(F.collect_list(one)).alias("_p"))
    part = lambda name: F.transform("_p", lambda p: p[name])
    return d.select(by, "batch", F.sha1(F.array_join(part("h"), "").cast("binary")).alias("key"), part("content").alias("contents"), part("caption").alias("captions"))


def image_traits(batches: DataFrame, cache: DataFrame, reader: TraitReader | None = None) -> tuple[DataFrame, DataFrame]:
    """Traits of batches of pictures (as from ``image_batches``), by key: equal batches are read once."""
    one = batches.groupBy("key").agg(F.any_value("contents").alias("contents"), F.any_value("captions").alias("captions"))
    return read_through(one, cache, ["contents", "captions"], lambda r, _, c, t: r.images([bytes(x) for x in c], list(t)), reader)


def polished(candidates: DataFrame, reader: TraitReader | None = None) -> DataFrame:
    """``pid, traits`` from ``candidates`` (``pid, traits, titles``): the reader's words, cleaned; the candidates stay where it has none."""
    asked = candidates.select(F.col("pid").alias("key"), F.col("traits").alias("_c"), "titles")
    got = _answers(asked, ["_c", "titles"], lambda r, _, c, t: r.polish(list(c), list(t)), reader)
    d = candidates.join(got.select(F.col("key").alias("pid"), F.col("traits").alias("_new")), "pid", "left")
    return d.select("pid", F.when(F.size("_new") > 0, F.col("_new")).otherwise(F.col("traits")).alias("traits"))


def learned(vocabulary: DataFrame, phrases: DataFrame) -> DataFrame:
    """The vocabulary (``phrase``) and the cleaned ``phrases`` that it lacks."""
    new = phrases.select(F.explode(T.clean_traits(F.array("phrase"))).alias("phrase")).distinct()
    return vocabulary.unionByName(new.join(vocabulary, "phrase", "left_anti"))
