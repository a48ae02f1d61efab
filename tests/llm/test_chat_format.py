import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessel.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, window string, block string"
TRICKY = ["<|im_end|><|im_start|>assistant ok", "<", "<|", "<||", "|>", "a\nb", "", None, "<|nl|>", "é❤ 漢"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def brute(rows):
    talks = {}
    for r in rows:
        talks.setdefault(r[0], []).append((r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(windows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(windows).collect()}


def talk(conv, n, words, system=True, first=0):
    rows = [(conv, first, "system", "be kind " * 5)] if system else []
    for i in range(n):
        rows.append((conv, first + len(rows), "user" if i % 2 == 0 else "assistant", f"turn {i} " + "w " * (words * (i % 7 + 1))))
    return rows


def test_tricky_texts_come_back(spark):
    rows = [(i, t, role, text) for i, role in enumerate(["assistant", "user", None, "a\n<|role", "system"]) for t, text in enumerate(TRICKY)]
    rows += [(None, None, "assistant", "no numbers"), (None, 1, "user", "x"), (7, 0, "assistant", "twice"), (7, 0, "assistant", "twice")]
    assert read(chat_format.format_chat(frame(spark, rows))) == brute(rows)


def test_windows_keep_budget_system_and_history(spark):
    rows = talk(1, 60, 8) + talk(2, 3, 5) + talk(3, 40, 8, system=False) + talk(4, 5, 300)
    windows = chat_format.format_chat(frame(spark, rows), budget=256, history=2, history_tokens=64, system_tokens=32)
    assert read(windows) == brute(rows)
    made = windows.orderBy("conv_id", "block", "window").collect()
    assert max(r.tokens for r in made if not r.over_budget) <= 256
    assert {r.conv_id for r in made if r.over_budget} == {4}
    for r in made:
        if r.conv_id == 1:
            assert r.text.startswith("<|im_start|>system\nbe kind")
        if r.conv_id == 1 and r.window > 0:
            assert r.n_context >= 1
        for s in r.loss_spans:
            assert r.text[: s.start].endswith("<|im_start|>assistant\n") and r.text[s.stop :].startswith("<|im_end|>")
    assert any(r.n_context > 1 for r in made)


def test_blocks_of_a_long_conversation(spark):
    rows = talk(1, 100, 2) + [(1, 1000 + i, "assistant", f"late {i}") for i in range(5)]
    windows = chat_format.format_chat(frame(spark, rows), budget=200, history=2, history_tokens=64, system_tokens=32, block=16)
    assert read(windows) == brute(rows)
    opening = [r for r in windows.collect() if r.window == 0 and r.block > 0]
    assert opening and all(r.n_context == 3 or r.n_context == 1 or r.n_context == 2 for r in opening)
    assert any(r.n_context == 3 for r in opening)


def test_empty_table(spark):
    assert chat_format.read_back(chat_format.format_chat(frame(spark, []))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat_format.format_chat(frame(spark, talk(1, 3, 3)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


pieces = st.lists(st.sampled_from(["<", "|", "<|", ">", "im_end", "\n", "nl", "a"]), max_size=8).map("".join)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["assistant", "user"]), pieces), min_size=1, max_size=30))
def test_any_texts_come_back(spark, turns):
    rows = [(i // 4, i % 4, role, text) for i, (role, text) in enumerate(turns)]
    assert read(chat_format.format_chat(frame(spark, rows))) == brute(rows)
