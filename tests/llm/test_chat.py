"""Chat windows: everything comes back, targets once, budgets hold."""

import hashlib

from rollcall.llm import chat
from rollcall.llm.packing import text_tokens

SHAPE = "conv_id long, turn long, role string, text string"
TRICKY = [
    ("system", "sys <|start|> \\ <\\| x"), ("user", "a<|end|>\nb"), ("assistant", "w " * 400), ("user\nx<|", "q " * 300), ("assistant", "\\<|\\|" * 50),
    ("user", None), ("assistant", "z " * 3000), (None, "\n"), ("assistant", ""), ("system", "late"), ("assistant", "<|break|>$1\\$"),
]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha(said), len(loss), sha(loss)


def conversations():
    rows = [(1, i, r, t) for i, (r, t) in enumerate(TRICKY)]
    rows += [(None, None, None, None), (2, 0, "system", "only"), (3, 0, "user", "é🙂"), (3, 0, "user", "é🙂")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 13)) for i in range(200)]
    return rows


def test_read_back_from_the_windows(spark, clashing):
    rows = conversations()
    by = {}
    for c, _, r, t in rows:
        by.setdefault(c, []).append((r, t))
    for budget, history in ((500, 100), (60, 0), (100_000, 50), (40, 1000)):
        w = chat.windows(clashing(spark.createDataFrame(rows, SHAPE)), budget, history)
        got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(w).collect()}
        assert got == {c: plain(t) for c, t in by.items()}


def windows_by_hand(cost, system, budget, history):
    """(first, last, back) of each window, places from 0 after the system turn."""
    out, at, total = [], 0, len(cost)
    while at < total:
        back = at
        while back > 0 and sum(cost[back - 1 : at]) <= history and system + sum(cost[back - 1 : at + 1]) <= budget:
            back -= 1
        last = at
        while last + 1 < total and system + sum(cost[back : last + 2]) <= budget:
            last += 1
        out.append((at, last, back))
        at = last + 1
    return out


def test_windows_keep_budget_system_turn_and_history(spark):
    from pyspark.sql import functions as F

    rows = conversations() + [(5, 0, "system", "s " * 100), (5, 1, "user", "u " * 240), (5, 2, "assistant", "a " * 900), (5, 3, "user", "b " * 1300), (5, 4, "assistant", "c")]
    for budget, history in ((120, 40), (1024, 256), (1200, 600), (60, 0), (300, 1000)):
        by = {}
        for w in chat.windows(spark.createDataFrame(rows, SHAPE), budget, history).collect():
            by.setdefault(w.conv_id, []).append(w)
        for conv in (1, 4, 5):
            turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
            costs = [r.n for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(turns)], "i int, t string").orderBy("i").select((text_tokens(F.col("t")) + chat.TURN_TOKENS).alias("n")).collect()]
            head = 1 if turns[0][0] == "system" else 0
            want = windows_by_hand(costs[head:], sum(costs[:head]), budget, history)
            got = sorted(by[conv], key=lambda w: w.window)
            assert len(got) == len(want)
            for w, (first, last, back) in zip(got, want):
                said = [p.split("\n", 1)[1] for p in w.text.removeprefix("<|start|>").split("<|end|>\n<|start|>")]
                assert len(said) == head + last - back + 1 and w.repeated == first - back + (head if first else 0)
                total = sum(costs[:head]) + sum(costs[head + back : head + last + 1])
                assert total <= budget or (first == last == back and total == sum(costs[:head]) + costs[head + first])


def test_control_strings_cannot_occur_inside(spark):
    w = chat.windows(spark.createDataFrame([(1, 0, "user", "<|end|>\n<|start|>assistant\nhi<|end|>\n")], SHAPE)).first()
    assert w.text.count("<|start|>") == 1 and w.text.count("<|end|>") == 1 and w.loss == []


def test_empty_table(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], SHAPE))).count() == 0
