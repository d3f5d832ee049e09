"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import slices

#: Words whose ids a Python worker keeps, at most, before it starts afresh. This changes speed and no result.
WORDS_KEPT = 600_000
#: Letter words that are encoded in one call.
JOINED = 200
#: Documents of a group on average. Groups are independent, so their number alone grows with the corpus.
GROUP_DOCS = 4000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_tokenizers: dict = {}


#: The settings under which a text's ids are those of its white-space separated words in turn, and a run of stops after
#: a letter or digit is a token run of its own.
_WORDWISE = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


#: Letters and digits that end in a letter or digit in lower case and composed form too.
_STABLE = "a-zA-Z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


def is_wordwise(path: str) -> bool:
    """Whether the tokenizer file drops white space, lower-cases and splits as _WORDWISE says, and marks word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first, *rest = pre.get("pretokenizers") or [{}]
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": _WORDWISE["split"]} and first.get("behavior") == "Removed" and first.get("invert") is True
    plain = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in rest)
    ends = spec.get("model", {}).get("type") == "BPE" and spec["model"].get("end_of_word_suffix") and not spec["model"].get("dropout")
    special = all(t["content"].startswith("<|") and not t.get("lstrip") and not t.get("rstrip") for t in spec.get("added_tokens", []))
    return bool(norm.get("normalizers") == _WORDWISE["normalizer"] and split and plain and ends and special and not spec.get("truncation") and not spec.get("padding"))


class _Texts:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        out = []
        for k in range(0, len(texts), 500):
            out += [e.ids for e in self.tok.encode_batch_fast(texts[k : k + 500], add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and the offsets of each text's ids."""
        ids = [np.array(x, np.uint32) for x in self.ids_of(pc.fill_null(texts, "").to_pylist())]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)


class _Words(_Texts):
    """For a word-wise tokenizer: each different word is encoded once and its ids kept.

    Of a plain ASCII word the case is dropped as the tokenizer does; stops after a letter or digit are looked up apart."""

    def __init__(self, path: str):
        super().__init__(path)
        end = self.tok.model.end_of_word_suffix
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(end)]] = True
        self._clear()

    def _clear(self) -> None:
        self.number, self.n, self.flat = {}, np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Letter words are encoded many at a time: each is one run that ends with an end of word."""
        letters, rest, runs, sizes = [], [], [], []
        for w in words:
            (letters if w.isalpha() else rest).append(w)
        for k in range(0, len(letters), JOINED):
            some = letters[k : k + JOINED]
            ids = np.array(self.ids_of([" ".join(some)])[0], np.int64)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(some) and at[-1] == len(ids) - 1:
                runs.append(ids)
                sizes.append(np.diff(at, prepend=-1))
            else:  # a letter whose lower case is none, say
                one = self.ids_of(some)
                runs.append(np.array([i for x in one for i in x], np.int64))
                sizes.append(np.array([len(x) for x in one]))
        one = self.ids_of(rest)
        runs.append(np.array([i for x in one for i in x], np.int64))
        sizes.append(np.array([len(x) for x in one], np.int64))
        self.number.update(zip([*letters, *rest], range(len(self.n), len(self.n) + len(words))))
        self.n = np.concatenate([self.n, *sizes])
        self.flat = np.concatenate([self.flat, *(r.astype(np.uint32) for r in runs)])

    def lookup(self, words: list[str]) -> np.ndarray:
        """The number of each word among those kept; new ones are encoded."""
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn([words[i] for i in new])
            at[new] = [self.number[words[i]] for i in new]
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > WORDS_KEPT:
            self._clear()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        open_ = pc.equal(pc.count_substring(words, "<|"), 0)  # no special token
        words = pc.if_else(pc.and_(open_, pc.string_is_ascii(words)), pc.ascii_lower(words), words)
        stopped = pc.and_(open_, pc.match_substring_regex(words, f"[{_STABLE}][.,!?]+$"))
        core = pc.if_else(stopped, pc.ascii_rtrim(words, ".,!?"), words).dictionary_encode()
        # what is left of a stopped word behind its stem: stops only
        tail = pc.replace_substring_regex(words.filter(stopped), f"^.*[{_STABLE}]([.,!?]+)$", r"\1").dictionary_encode()
        cores, tails = self.lookup(core.dictionary.to_pylist()), self.lookup(["", *tail.dictionary.to_pylist()])
        parts = np.full((len(words), 2), tails[0])
        parts[:, 0] = cores[core.indices.to_numpy(zero_copy_only=False)]
        parts[stopped.to_numpy(zero_copy_only=False), 1] = tails[1:][tail.indices.to_numpy(zero_copy_only=False)]
        flat, ends = _gather(self.flat, self.n, parts.ravel())
        flat, ends = _gather(flat, np.diff(ends[::2]), coded.indices.to_numpy(zero_copy_only=False))
        texts_at = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(texts) else np.zeros(1, np.int64)
        return flat, ends[texts_at]


def _gather(flat: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` in turn, of runs of lengths ``n`` in ``flat``, and the ends of each."""
    first = np.concatenate(([0], np.cumsum(n)))
    n = n[at]
    ends = np.concatenate(([0], np.cumsum(n)))
    return flat[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])], ends


def _tokenizer(path: str) -> _Texts:
    if path not in _tokenizers:
        _tokenizers[path] = _Words(path) if is_wordwise(path) else _Texts(path)
    return _tokenizers[path]


def _pieces(path: str, size: int, end_id: int):
    """mapInArrow over (doc_id, text): the pieces of each document, cut only where a sequence is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words = _tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at = words.encode(part.column("text"))
                rows = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), size):
                        cut = ids[s : s + size]
                        rows.append((doc, s, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items go in falling order to the first bin with room.

    A tournament tree holds the largest free room below each node, so the first bin that fits is found in
    logarithmic time. Equal lengths keep their order."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [size] * (2 * leaves)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, k = int(lengths[i]), 1
        while k < leaves:
            k *= 2
            if tree[k] < need:
                k += 1
        where[i], offset[i] = k - leaves, size - tree[k]
        tree[k] -= need
        k //= 2
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            top = left if left > right else right
            if tree[k] == top:
                break
            tree[k] = top
            k //= 2
    return where, offset


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """Pack documents (``doc_id``, ``text``) into sequences of at most ``size`` tokens.

    Each document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Documents longer than a
    sequence are cut at multiples of ``size``; whole sequences stand alone and the rest go through first-fit
    decreasing in groups drawn by a seeded hash. Returns per piece ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``; ``sequence_id`` is unique, not gapless. Repeated rows are packed each on their own.
    An empty table gives no rows; further columns are ignored. Only piece sizes and checksums are shuffled, never
    ids or texts."""
    n_groups = max(1, -(-docs.count() // group_docs))
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, size, end_id), PIECES)
    # drawn by all columns, so that rows without an id are spread as well
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(n_groups)))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        where, offset = first_fit_decreasing(pdf["length"].to_numpy(), size)
        pdf["sequence_id"], pdf["offset"] = where + (int(key[0]) << 32), offset
        return pdf.drop(columns="grp")

    return pieces.groupBy("grp").applyInPandas(fit, f"{PIECES}, sequence_id long, offset long")
