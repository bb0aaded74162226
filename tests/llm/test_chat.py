import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import chat
from marlstone.llm.tokens import tokenizer

PIECES = ["\\", "<", "</turn>", "<turn>", "\n", "l", "n", "a", "é", "😀", "字", " ", "\\n", "<|endoftext|>", "### Assistant:"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\n<\\", ""]), TEXT), max_size=5))
def test_round_trip_and_mask(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    ids, offsets = chat.offsets_of(tokenizer("byte_bpe_50k.json", plain=True), text)
    flags, kept = chat.mask(offsets, spans)
    assert chat.unescape("".join(text[a:b] for a, b in kept)) == "".join(t for r, t in turns if r == "assistant")
    want = [any(min(b, y) > max(a, x) for x, y in spans) for a, b in offsets.tolist()]
    assert flags.tolist() == want and len(ids) == len(flags)


def test_rows(spark):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["x < y", None, "", "\\l", "long " * 4000])) for c in (1, 2, None) for t in range(5)]
    rows += [rows[0], (9, None, "assistant", "z"), (9, 1, "assistant", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert len(out) == 4
    for c, r in out.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for x, t, role, text in rows if x == c))
        turns = [x[2:] for x in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_a_conversation_of_many_turns(spark):
    n = 100_000
    df = spark.range(n).selectExpr("5L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    r = chat.read_back(chat.format_chats(df)).first()
    assert r.n_turns == n and r.loss_chars == sum(len(f"t{i}") for i in range(1, n, 2))
    assert r.turns_sha256 == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(n)).encode()).hexdigest()
