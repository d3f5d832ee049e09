"""Chat windows: escapes and templates there and back, budgets, masks, and the query by a plain version."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitrine.llm import chat_format as C
from vitrine.llm import queries

TOKENS = public_tokenizers.path("word_bpe_49k.json")
PIECES = [*C.CONTROL, *(c[0] + "\\" + c[1:] for c in C.CONTROL), "<", "[", "\\", "|", "s>", "/s>", "im_end|>", "INST]", "SYS>>", "\n", "n", "é", " a "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=9).map("".join), st.lists(st.sampled_from(PIECES), max_size=5).map("".join))
def test_escape_round_trip(text, role):
    assert C.unescaped(C.escaped(text)) == text and C.unescaped_role(C.escaped_role(role)) == role
    assert not any(c in C.escaped(text) for c in C.CONTROL)
    shown, begin = C.marked(role, text)
    (got,) = C.turns_of(shown)
    assert got[:2] == (role, text) and got[2] == begin and C.unescaped(shown[begin : got[3]]) == text


def plain(conversations):
    """Per conversation what the windows must say, from its rows."""
    out = {}
    by = {}
    for c, turn, role, text in conversations:
        by.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for c, rows in by.items():
        rows.sort()
        loss = [t for _, _, r, t in rows if r == "assistant"]
        out[c] = len(rows), sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows)), sum(map(len, loss)), sha("".join(loss))
    return out


def check_windows(rows, conversations, budget, history):
    tok = Tokenizer.from_file(TOKENS)
    count = lambda m: len(tok.encode(m, add_special_tokens=False).ids)
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], {})[r["window"]] = r
    assert by.keys() == {c for c, *_ in conversations}
    for windows in by.values():
        assert sorted(windows) == list(range(len(windows)))
        turns, first = [], None
        for k in range(len(windows)):
            w = windows[k]
            got = C.turns_of(w["text"])
            assert "".join(C.marked(r, t)[0] for r, t, _, _ in got) == w["text"] and len(got) == w["n_turns"]
            sizes = [count(C.marked(r, t)[0]) for r, t, _, _ in got]
            assert sum(sizes) == w["tokens"] and (w["tokens"] <= budget or len(got) == 1)
            old, new = got[: w["n_repeated"]], got[w["n_repeated"] :]
            assert new and [(s["start"], s["end"]) for s in w["loss"]] == [(a, b) for r, _, a, b in new if r == "assistant"]
            if k:
                system = bool(old) and first[0] == "system" and old[0][:2] == first
                rest = [t[:2] for t in old[system:]]
                assert rest == turns[len(turns) - len(rest) :] and sum(sizes[system : len(old)]) <= history
                # greedy: the first new turn did not fit before, and one more turn of the past wouldn't here
                assert windows[k - 1]["tokens"] + sizes[len(old)] > budget
                past = turns[1:] if first[0] == "system" else turns
                if len(rest) < len(past):
                    more = sum(sizes[system : len(old)]) + count(C.marked(*past[-len(rest) - 1])[0])
                    # a span in between may have cut the past short by its own turns only
                    assert more > min(history, budget - sizes[len(old)] - (sizes[0] if system else 0))
                if first[0] == "system":
                    assert system or count(C.marked(*first)[0]) + sizes[len(old)] > budget
            else:
                assert not old
                first = got[0][:2]
            turns += [t[:2] for t in new]


@pytest.mark.parametrize("budget,history", [(1024, 256), (200, 60), (90, 0), (1, 1)])
def test_windows(spark, budget, history):
    rng = np.random.default_rng(budget)
    rows = []
    for c in range(40):
        roles = (["system"] if c % 3 else []) + ["user", "assistant"] * int(rng.integers(1, 9))
        if c % 7 == 0:
            roles += ["system", "tool"]
        for i, r in enumerate(roles):
            rows.append((c, i, r, " ".join(rng.choice(["word", "<|im_end|>", "é", "[INST]", "\n", "\\"], int(rng.integers(0, 60))))))
    got = C.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOKENS, budget, history).collect()
    check_windows(got, rows, budget, history)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, 0, None, "a"), (None, None, "user", "x"), (None, 2, "assistant", "y\n")]
    rows += [(3, i, ["user", "assistant"][i % 2], "w " * 30_000) for i in range(3)] + [(4, 0, "a\nb\\", "<|im_start|>user\n")]
    rows += [(5, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(3000)]  # far more turns than a window holds
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "2 AS loss", "3 AS tokens")
    windows = C.windows(d, TOKENS)
    got = windows.collect()
    check_windows(got, [(c, t, r, x) for c, t, r, x in rows], 1024, 256)
    back = {r["conv_id"]: tuple(r)[1:5] for r in C.read_back(windows).collect()}
    assert back == plain(rows)
    assert C.windows(d.limit(0), TOKENS).count() == 0 and C.read_back(windows.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.CHAT_ODD
    got = {r["conv_id"]: r for r in queries.op12_chat_format(spark, sf).collect()}
    want = plain(rows)
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    length = {}
    for c, _, role, text in rows:
        length[c] = length.get(c, 0) + len(C.marked(role or "", text or "")[0])
    assert all(r["formatted_chars"] >= length[c] for c, r in got.items()) and any(r["formatted_chars"] > length[c] for c, r in got.items())
