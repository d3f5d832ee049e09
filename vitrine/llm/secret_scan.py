"""Secret scans: Boolean trigram queries from each regex, postings intersected per block of texts, candidates verified."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vitrine.llm.common import slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, of whose ``group`` a match must have ``least`` characters. The regex must not ignore case."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    regex: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "regex", re.compile(self.pattern))

    def trigrams(self) -> list[list[set[str]]]:
        """The Boolean query: an AND of ORs of ANDs of lower-case trigrams, one OR for each run of literals that every match
        holds; empty where there is none, and the rule scans whole texts."""
        runs = [[{s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(run)] for run in mandatory(self.pattern)]
        return [run for run in runs if all(run)]

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


#: Strings that a part of a regex may stand for, at most, before it counts as open.
MAX_STRINGS = 16


def _strings(node: tuple) -> set[str] | None:
    """The lower-case strings that a parsed regex node matches, or None if they are too many or not all ASCII."""
    what, arg = node
    if what is op.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if what is op.IN:
        out = set()
        for kind, x in arg:
            if kind is op.LITERAL:
                out.add(x)
            elif kind is op.RANGE and x[1] - x[0] < 2 * MAX_STRINGS:
                out.update(range(x[0], x[1] + 1))
            else:
                return None
        out = {chr(x).lower() for x in out} if all(x < 128 for x in out) else set()
        return out if 0 < len(out) <= MAX_STRINGS else None
    if what is op.SUBPATTERN:
        return _joined(arg[-1])
    if what is op.BRANCH:
        parts = [_joined(x) for x in arg[1]]
        out = set().union(*parts) if all(p is not None for p in parts) else set()
        return out if 0 < len(out) <= MAX_STRINGS else None
    if what in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 3:
        one, out = _joined(arg[2]), set()
        for n in range(arg[0], arg[1] + 1):
            out |= {"".join(p) for p in product(one or (), repeat=n)} if one is not None and len(one) ** n <= MAX_STRINGS else set()
        return out if one is not None and 0 < len(out) <= MAX_STRINGS and len(one) ** arg[1] <= MAX_STRINGS else None
    return {""} if what in (op.AT, op.ASSERT, op.ASSERT_NOT) else None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def mandatory(pattern: str) -> list[set[str]]:
    """Runs of the regex that stand for few strings: every match holds, letter case aside, one of each set's strings."""
    runs: list[set[str]] = []

    def walk(nodes) -> None:
        now = {""}
        for node in nodes:
            more = _strings(node)
            if more is not None and len(now) * len(more) <= MAX_STRINGS:
                now = {a + b for a in now for b in more}
                continue
            runs.append(now)
            now = more if more is not None else {""}
            if more is None and node[0] is op.SUBPATTERN:
                walk(node[1][-1])
            elif more is None and node[0] in (op.MAX_REPEAT, op.MIN_REPEAT) and node[1][0] > 0:
                walk(node[1][2])
        runs.append(now)

    walk(_parser.parse(pattern))
    return [r for r in runs if min(map(len, r)) >= 3]


def either(word: str) -> str:
    """A pattern for the word in either case of A-Z; the flag would match a few letters beyond ASCII too."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The rules whose matches always count.
BASE = (
    Rule(
        "assign",
        "(" + "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
#: Rules beside them: well-known shapes of keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    # a token starts where no such run goes before, and a scheme has a bounded length: both scan in linear time
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{0,30}://[^\s/:@]{1,64}:[^\s/@]{3,64}@"),
)


class BlockIndex:
    """Postings of a block of texts: for each trigram that some rule asks for, the set of texts that hold it."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = [r.trigrams() for r in rules]
        asked = sorted({t for q in self.queries for run in q for alt in run for t in alt})
        self.number = {t: i for i, t in enumerate(asked)}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = i

    def candidates(self, texts: pa.Array) -> list[np.ndarray]:
        """Per rule the positions of the texts that satisfy its query; all of them where it has none."""
        lower = pc.fill_null(pc.ascii_lower(texts), "")
        size = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(x.as_buffer() for x in lower if x.as_buffer() is not None), np.uint8)
        ends = np.cumsum(size)
        held = np.zeros((len(self.number), len(texts)), bool)
        if len(data) > 2:
            x = data.astype(np.int32)
            asked = self.table[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
            at = np.flatnonzero(asked >= 0)
            text = np.searchsorted(ends, at, side="right")
            inside = at + 3 <= ends[text]
            held[asked[at[inside]], text[inside]] = True
        out = []
        for q in self.queries:
            every = np.ones(len(texts), bool)
            for run in q:
                every &= np.logical_or.reduce([np.logical_and.reduce([held[self.number[t]] for t in sorted(alt)]) for alt in run])
            out.append(np.flatnonzero(every))
        return out


_index: dict = {}


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Find secrets in ``docs`` (``doc_id``, ``text``): one row per document with ``spans``, an array of
    ``struct<kind, start, end, base>`` by start and then rule order; positions are code points, ends exclusive.

    A null or empty text has no spans; repeated rows are scanned each; an empty table gives no rows; further columns
    are ignored. One pass without a shuffle: every task indexes its own blocks of texts."""
    rules = (*base, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(r.pattern for r in rules)
        index = _index.get(key) or _index.setdefault(key, BlockIndex(rules))
        kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            for part in slices(batch, "text"):
                column, found = part.column("text"), [[] for _ in range(part.num_rows)]
                for k, (rule, rows) in enumerate(zip(rules, index.candidates(column))):
                    for i in rows.tolist():
                        if text := column[i].as_py():
                            found[i] += [(a, k, b) for a, b in rule.spans(text)]
                spans = [[{"kind": rules[k].kind, "start": a, "end": b, "base": k < len(base)} for a, k, b in sorted(f)] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(kind_of))], ["doc_id", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def masked(text: str | None, spans: list, mark: str = "[{kind}]") -> str | None:
    """The text with each span replaced by a mark; overlapping spans are replaced once."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark.format(kind=s["kind"])]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of kind:start:end, comma-joined; for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
