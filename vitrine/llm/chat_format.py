"""Chat formatting in budgeted windows: turns as marked text, cut between turns so that each window keeps to a token budget.

Prefix sums of the turns' tokens choose the span of new turns of each window. Each window begins with the system turn; from
the second on it repeats as many of the turns before its span as the history budget holds. What is repeated is no target:
each assistant turn is under the loss mask once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import slices

# fixed values: control strings of public chat templates and tokenizers
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_REST = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == "<"), "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == "[")
#: A control string with any number of backslashes after its first character.
_MARKED = re.compile(rf"(?:<(?=\\*(?:{_REST[0]}))|\[(?=\\*(?:{_REST[1]})))")
_ESCAPED = re.compile(rf"(?:(?<=<)\\(?=\\*(?:{_REST[0]}))|(?<=\[)\\(?=\\*(?:{_REST[1]})))")
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)
#: Turns whose tokens are counted in one call.
COUNTED = 512
WINDOWS = "window long, n_turns long, n_repeated long, tokens long, text string, loss array<struct<start:long,end:long>>"


def escaped(text: str) -> str:
    """The text without control strings: each gets one backslash more after its first character."""
    return _MARKED.sub(lambda m: m[0] + "\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub("", text)


def escaped_role(role: str) -> str:
    """A role is one line."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def turns_of(text: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and start and end of the text as it stands there, of each turn of a window."""
    return [(unescaped_role(m[1]), unescaped(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text)]


@dataclass(frozen=True)
class Turn:
    role: str
    marked: str
    begin: int
    tokens: int

    @property
    def loss(self) -> tuple[int, int]:
        """Where the turn's own text stands in its marked form."""
        return self.begin, len(self.marked) - len(END) - 1


def _last(turns: list[Turn], most: int) -> list[Turn]:
    """The last turns whose tokens, by prefix sums from the end, come to ``most`` or fewer."""
    sums = np.cumsum([t.tokens for t in reversed(turns)]) if turns else np.zeros(0, np.int64)
    return turns[len(turns) - int(np.searchsorted(sums, most, "right")) :]


class Windows:
    """The windows of one conversation, whose turns are offered in order. It holds the system turn, the history and the
    turns of one span, never a whole conversation."""

    def __init__(self, budget: int, history: int, target: str, system: str):
        self.budget, self.history, self.target, self.first = budget, history, target, system
        self.system: Turn | None = None
        self.past: list[Turn] = []
        self.repeated: list[Turn] = []
        self.span: list[Turn] = []
        self.used = self.window = 0

    def offer(self, turn: Turn) -> Iterator[dict]:
        """Take a turn; gives the window that it no longer fits into."""
        if not self.span:  # the conversation's first turn
            self.system = turn if turn.role == self.first else None
        elif self.used + turn.tokens > self.budget:
            yield self.close()
            self.past = _last([*self.past, *(t for t in self.span if t is not self.system)], self.history)
            room = self.budget - turn.tokens
            head = [self.system] if self.system and self.system.tokens <= room else []
            self.repeated = [*head, *_last(self.past, room - sum(t.tokens for t in head))]
            self.span, self.used = [], sum(t.tokens for t in self.repeated)
        self.span.append(turn)
        self.used += turn.tokens

    def close(self) -> dict:
        """The window as it stands."""
        parts, loss, at = [], [], 0
        for i, t in enumerate([*self.repeated, *self.span]):
            if i >= len(self.repeated) and t.role == self.target:
                loss.append({"start": at + t.loss[0], "end": at + t.loss[1]})
            parts.append(t.marked)
            at += len(t.marked)
        out = {"window": self.window, "n_turns": len(parts), "n_repeated": len(self.repeated), "tokens": self.used, "text": "".join(parts), "loss": loss}
        self.window += 1
        return out


_tokenizers: dict = {}


def _counts(path: str, texts: list[str]) -> list[int]:
    if path not in _tokenizers:  # once per worker
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return [len(e.ids) for a in range(0, len(texts), COUNTED) for e in _tokenizers[path].encode_batch(texts[a : a + COUNTED], add_special_tokens=False)]


def marked(role: str, text: str) -> tuple[str, int]:
    """A turn as it stands in a window, and where its text begins."""
    head = f"{START}{escaped_role(role)}\n"
    return f"{head}{escaped(text)}{END}\n", len(head)


def windows(conversations: DataFrame, tokenizer: str, budget: int = 1024, history: int = 256, target: str = "assistant", system: str = "system") -> DataFrame:
    """Windows of ``conversations`` (``conv_id, turn, role, text``): ``conv_id, window, n_turns, n_repeated, tokens, text, loss``.

    ``tokens`` are those of the file ``tokenizer`` over the marked turns, and at most ``budget`` unless one turn alone has
    more, which then is a window of its own and is never cut. The first ``n_repeated`` turns of a window stand in an
    earlier one too: the conversation's first turn if its role is ``system``, and turns of at most ``history`` tokens before
    the span; either stays out where the span's first turn leaves no room. ``loss`` are spans of code points, ends
    exclusive, of the texts of new turns of role ``target``, as they stand there. Null texts and roles are empty ones;
    a null id is a conversation of its own; turns of one number follow by role and text, and repeated rows stay. An empty
    table gives no rows; further columns are ignored. A conversation's turns go through one task in order, which holds one
    window at a time, so its memory doesn't grow with the conversation."""
    kind = dict(conversations.dtypes)["conv_id"]
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Windows | None = None
        conv = None

        def made(found: list) -> pa.RecordBatch:
            ids = pa.array([c for c, _ in found], of_id)
            cols = [[w[n] for _, w in found] for n in ("window", "n_turns", "n_repeated", "tokens", "text", "loss")]
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, cols, types)], ["conv_id", "window", "n_turns", "n_repeated", "tokens", "text", "loss"])

        for batch in (part for whole in batches for part in slices(whole, "text")):
            of_id, found, held = batch.column("conv_id").type, [], 0
            ids, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            shown = [marked(r, t) for r, t in zip(roles, batch.column("text").to_pylist())]
            counts = _counts(tokenizer, [m for m, _ in shown])
            for c, role, (text, begin), n in zip(ids, roles, shown, counts):
                if now is None or c != conv:
                    if now is not None:
                        found.append((conv, now.close()))
                    conv, now = c, Windows(budget, history, target, system)
                for w in now.offer(Turn(role, text, begin, n)):
                    found.append((conv, w))
                    held += len(w["text"])
                if held > 8 << 20:
                    yield made(found)
                    found, held = [], 0
            yield made(found)
        if now is not None:
            yield made([(conv, now.close())])

    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, {WINDOWS}")


def read_back(formatted: DataFrame) -> DataFrame:
    """What ``windows`` says about each conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Turns are parsed from the texts, those repeated left out; the mask's spans are cut out of the texts. Hashes are fed
    window by window, so a conversation of any length passes."""
    kind = dict(formatted.dtypes)["conv_id"]
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "n_repeated", "text", "loss")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, found, of_id = None, [], None

        def done() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        def made(found: list) -> pa.RecordBatch:
            types = [of_id, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types], names)

        for batch in (part for whole in batches for part in slices(whole, "text")):
            of_id, found = batch.column("conv_id").type, []
            for r in batch.to_pylist():
                if state is None or state[0] != r["conv_id"]:
                    if state is not None:
                        found.append(done())
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in turns_of(r["text"])[r["n_repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for s in r["loss"]:
                    text = unescaped(r["text"][s["start"] : s["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(r["text"])
            yield made(found)
        if state is not None:
            yield made([done()])

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
