"""Chat templates: incremental tokens against whole-prefix encoding."""

import random

import pytest

from trajlake.operators import chat


def words(text):
    """A tokenizer with the ends as tokens of their own and pieces of up to three letters."""
    out, at = [], 0
    marks = ("<|im_end|>", "<|im_start|>", "<|eot_id|>")
    while at < len(text):
        mark = next((m for m in marks if text.startswith(m, at)), None)
        stop = at + len(mark) if mark else min([at + 3, len(text), *[p for m in marks if (p := text.find(m, at)) > 0]])
        out.append(hash(text[at:stop]) & 0x7FFFFFFF)
        at = stop
    return out


def whole(messages, model):
    """The rule itself: each prefix rendered and encoded anew, the tokens beyond the number before."""
    before = 0
    for i in range(len(messages)):
        prefix = messages[:i + 1]
        prompt = prefix[-1]["role"] != "assistant" and i < len(messages) - 1
        try:
            text, failed = model.render(prefix, add_generation_prompt=prompt), False
        except ValueError:
            text, failed = "\n".join(f"{m['role']}: {m['content']}" for m in prefix), True
        ids = model.encode(text)
        yield ids[before:], len(ids), failed
        before = len(ids)


def conversation(rng):
    out = []
    for _ in range(rng.randrange(12)):
        role = rng.choice(["system", "user", "assistant", "assistant", "tool"])
        content = "".join(rng.choice("ab \n") for _ in range(rng.randrange(30)))
        if role == "assistant" and rng.random() < 0.6:
            content = f"<think>{content}</think>\n{content[:5]}"
        out.append({"role": role, "content": content})
    return out


@pytest.mark.parametrize("name", sorted(chat.TEMPLATES))
def test_incremental_equals_whole_prefixes(name):
    rng = random.Random(name)
    for _ in range(60):
        talk = conversation(rng)
        calls = []

        def encode(text):
            calls.append(len(text))
            return words(text)

        model = chat.chat_model(encode, chat.TEMPLATES[name])
        got = [tuple(d) for d in chat.prefix_deltas_of(talk, model)]
        assert got == list(whole(talk, model._replace(encode=words)))


def test_shared_text_is_not_encoded_again():
    talk = [{"role": ("user", "assistant")[i % 2], "content": "x" * 100} for i in range(40)]
    calls = []
    model = chat.chat_model(lambda text: calls.append(len(text)) or words(text), chat.TEMPLATES["chatml"])
    list(chat.prefix_deltas_of(talk, model))
    total = len(chat.TEMPLATES["chatml"].render(talk))
    assert sum(calls) < 2 * total


def test_shared_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(2))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert chat.shared_length(a, b) == n


def load():
    return chat.chat_model(words_by_length, chat.TEMPLATES["strict"])


def words_by_length(text):
    return [len(w) for w in text.split()]


def test_rows_fall_back_where_the_template_fails(make):
    rows = [("t", 0, "user", "hello there"), ("t", 1, "assistant", "hi"), ("t", 2, "assistant", None), ("u", 5, "tool", "x y"), (None, 0, None, "z")]
    out = chat.tokenize_chat(make(rows, "trajectory_id string, msg_idx int, role string, content string"), load)
    got = {(r.trajectory_id, r.msg_idx): (list(r.ids), r.n_prefix, r.fallback) for r in out.collect()}
    assert got["t", 0] == ([6, 5, 5, 11], 4, False)  # [user] hello there [assistant]
    assert got["t", 1] == ([2], 5, False)
    # user: hello there / assistant: hi / assistant:
    assert got["t", 2] == ([10], 6, True)
    assert got["u", 5] == ([5, 1, 1], 3, True) and got[None, 0] == ([1, 1], 2, True)


def test_public_tokenizer_file(make):
    files = pytest.importorskip("public_tokenizers")
    path = str(files.path("byte_bpe_50k.json"))
    model = chat.tokenizer_file_model(path, chat.TEMPLATES["chatml-thinking"])()
    rng = random.Random(3)
    for _ in range(15):
        talk = conversation(rng)
        assert [tuple(d) for d in chat.prefix_deltas_of(talk, model)] == list(whole(talk, model))
