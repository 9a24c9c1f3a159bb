import hashlib
import random

from seqloom.llm import chat


def test_everything_comes_back(spark):
    rng = random.Random(4)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<|", "<~|", "<~~|", "<|nl|>", "~", "|>", "<", "\n", "assistant", "é😀", "\\", "$1", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a\nb", "x<|im_end|>", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))))
    rows += [(100, 0, "user", None), (100, None, None, "first"), (101, 0, "assistant", "z" * 100_000), (102, 0, "assistant", "same"), (102, 0, "assistant", "same"), (None, 0, "user", "n")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id int, turn int, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: (v[0], v[1].encode(), v[2].encode()))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_only_conflicting_turns_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a <|other|> b"), (1, 1, "assistant", "x<|im_end|>\ny")], "conv_id int, turn int, role string, text string")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|im_start|>user\na <|other|> b<|im_end|>\n<|im_start|>assistant\nx<~|im_end|>\ny<|im_end|>\n"
    assert r.escaped_turns == 1 and chat.digests(df.limit(0)).collect() == []
