import hashlib
import random

from codequarry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed: int, n: int = 40) -> list[tuple]:
    rng, rows = random.Random(seed), []
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "\\\\", "<<SYS>>", "plain words", "é漢", "\n", "[\\/INST]", ""]
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 40, 900]))) if rng.random() > 0.05 else None
            rows.append((c, t, "system" if t == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant"]), text))
    return rows


def plain(rows: list[tuple]) -> dict:
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digest(spark, rows, schema=SCHEMA) -> dict:
    found = chat.digest(chat.windows(spark.createDataFrame(rows, schema))).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found}


def test_round_trip(spark):
    rows = conversations(1)
    assert digest(spark, rows) == plain(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "x"), (1, 0, "assistant", "y"), (1, 0, "user", "x"), (2, None, None, None), (3, 0, "assistant", "")]
    assert digest(spark, rows) == plain(rows)


def test_extra_columns(spark):
    rows = [(1, 0, "user", "hi", 7, "s"), (1, 1, "assistant", "yes", 8, "t")]
    assert digest(spark, rows, SCHEMA + ", tokens int, span string") == plain([r[:4] for r in rows])


def test_empty(spark):
    assert digest(spark, []) == {}


def test_control_strings_are_escaped(spark):
    found = chat.windows(chat.with_special(spark, spark.createDataFrame([], SCHEMA))).first()
    assert found["formatted"].count(chat.END) == 2 and found["formatted"].count(chat.BEGIN) == 2 and found["formatted"].count(chat.MIDDLE) == 2


def test_windows_keep_the_budget_and_repeat_history_without_loss(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, t, "user" if t % 2 else "assistant", chr(97 + t % 26) * 180) for t in range(1, 60)]
    found = chat.windows(spark.createDataFrame(rows, SCHEMA), budget=400, history=100).orderBy("span").collect()
    assert len(found) > 5
    for r in found:
        pieces = r["formatted"].split(chat.END)[:-1]
        cost = sum(-(-len(p.split(chat.MIDDLE, 1)[1]) // chat.CHARS_PER_TOKEN) + chat.TURN_TOKENS for p in pieces)
        assert cost <= 400
        assert pieces[0].startswith(chat.BEGIN + "system")
        assert len(r["loss"]) == sum(p.startswith(chat.BEGIN + "assistant") for p in pieces[r["n_context"] :])
    assert sum(r["n_context"] for r in found) > len(found)
