"""Conversation collapse against comparing all pairs."""

import random

from quillon.llm import chat


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else "") for x in t)
    seqs = {c: tuple((r, t) for _, r, t in sorted(ts, key=key)) for c, ts in convs.items()}
    out = set()
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        twins = [d for d, o in seqs.items() if o == s]
        first = min((d for d in twins if d is not None), default=None)
        if not longer and c == first:
            out.add((c, len(s), len(twins), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in s)))
    return out


def result(df):
    rows = df.collect()
    text = {}
    for r in sorted(rows, key=lambda r: r.part):
        old = text.get((r.conv_id, r.n_turns, r.copies), "")
        text[(r.conv_id, r.n_turns, r.copies)] = old + r.text
    return {(*k, t) for k, t in text.items()}


def test_random(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 4)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]) if turn else "user", rng.choice(["x", "y", None, "xy"]) if turn else "hi"))
    rows += [(100, None, None, None), (101, 5, "user", "hi"), (101, 5, "user", "hi")]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "conv_id long, turn long, role string, text string, pos int, block string")
    assert result(chat.format_conversations(df)) == brute(rows)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    rows = [(c, t, "user", f"t{t}") for c, n in [(1, 13), (2, 11), (3, 13), (4, 4)] for t in range(n)]
    rows += [(5, t * 10, "user", f"t{t}") for t in range(14)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    assert result(out) == brute(rows) and {r.conv_id for r in out.collect()} == {5}
    assert sorted(r.part for r in out.collect()) == [0, 1, 2, 3]
