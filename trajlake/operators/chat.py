"""Token rows under a model's chat template, which need not grow by appending.

A message contributes the tokens of the conversation up to it that lie beyond the number of tokens
before it. Templates may rewrite earlier messages as a conversation grows (drop past reasoning, say), so
each prefix is rendered as a whole; its tokens are taken over from the prefix before as far as the two
texts agree, and only the rest is encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

TRAJECTORY = ("trajectory_id",)
THINKING = ("<think>", "</think>")


class ChatTemplate(NamedTuple):
    """How a model's conversations read.

    ``message`` is formatted with role and content. ``ends`` close a message and are tokens of their own
    in the model's vocabulary, so that texts may be encoded apart there. ``past_thinking`` false drops the
    reasoning of assistant messages before the last user message. ``strict`` templates reject roles other
    than an opening system and then user and assistant in turn.
    """

    message: str
    generation: str
    begin: str = ""
    ends: tuple[str, ...] = ()
    past_thinking: bool = True
    strict: bool = False
    trim: bool = False

    def render(self, messages: Sequence[dict], add_generation_prompt: bool = False) -> str:
        if self.strict:
            turns = [m["role"] for m in messages]
            turns = turns[1:] if turns[:1] == ["system"] else turns
            if any(role != ("user", "assistant")[i % 2] for i, role in enumerate(turns)):
                raise ValueError("roles must alternate between user and assistant")
        asked = max((i for i, m in enumerate(messages) if m["role"] == "user"), default=-1)
        out = [self.begin]
        for i, m in enumerate(messages):
            content = m["content"].strip() if self.trim else m["content"]
            if not self.past_thinking and m["role"] == "assistant" and i < asked:
                content = without_thinking(content)
            out.append(self.message.format(role=m["role"], content=content))
        return "".join(out) + (self.generation if add_generation_prompt else "")

    def cut(self, text: str) -> int:
        """Where the text may be cut so that both parts are encoded as they are in any text that goes on from it."""
        return max((at + len(end) for end in self.ends if (at := text.rfind(end)) >= 0), default=0)


# The layouts of two families of chat models and of plain lines.
TEMPLATES = {
    "chatml": ChatTemplate("<|im_start|>{role}\n{content}<|im_end|>\n", "<|im_start|>assistant\n", ends=("<|im_end|>",)),
    "chatml-thinking": ChatTemplate(
        "<|im_start|>{role}\n{content}<|im_end|>\n", "<|im_start|>assistant\n", ends=("<|im_end|>",), past_thinking=False),
    "headers": ChatTemplate(
        "<|start_header_id|>{role}<|end_header_id|>\n\n{content}<|eot_id|>",
        "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|begin_of_text|>", ends=("<|eot_id|>",), trim=True),
    "strict": ChatTemplate("[{role}] {content}\n", "[assistant] ", strict=True),
}


def without_thinking(content: str) -> str:
    """The content from after its last closed reasoning block."""
    return content.rsplit(THINKING[1], 1)[-1].lstrip("\n") if THINKING[1] in content else content


def plain_lines(messages: Sequence[dict]) -> str:
    """What stands in for a template that fails: ``role: content`` lines."""
    return "\n".join(f"{m['role']}: {m['content']}" for m in messages)


class ChatModel(NamedTuple):
    """A tokenizer and its template. ``cut`` may be None: prefixes are then encoded as a whole each time."""

    encode: Callable[[str], list[int]]
    render: Callable[..., str]
    cut: Callable[[str], int] | None = None


def chat_model(encode: Callable[[str], list[int]], template: ChatTemplate) -> ChatModel:
    return ChatModel(encode, template.render, template.cut if template.ends else None)


def tokenizer_file_model(path: str, template: ChatTemplate) -> Callable[[], ChatModel]:
    """A loader for ``tokenize_chat`` from the JSON file of a public tokenizer, whose vocabulary gets the template's ends."""
    def load() -> ChatModel:
        from tokenizers import Tokenizer  # third party, needed on executors only

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens(list(template.ends))
        return chat_model(lambda text: tokenizer.encode(text, add_special_tokens=False).ids, template)

    return load


def shared_length(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class PrefixEncoder:
    """Tokens of one growing conversation after the other; what a new text shares with the last is not encoded again."""

    def __init__(self, model: ChatModel):
        self.model = model
        self.text = ""
        self.ids: list[int] = []
        # (characters, tokens) up to each place where the text was cut.
        self.marks = [(0, 0)]

    def encode(self, text: str) -> list[int]:
        shared = shared_length(self.text, text)
        while self.marks[-1][0] > shared:
            self.marks.pop()
        at, n = self.marks[-1]
        del self.ids[n:]
        cut = self.model.cut(text) if self.model.cut else 0
        if cut > at:
            self.ids += self.model.encode(text[at:cut])
            self.marks.append((cut, len(self.ids)))
            at = cut
        if at < len(text):
            self.ids += self.model.encode(text[at:])
        self.text = text
        return self.ids


class Delta(NamedTuple):
    ids: list[int]
    n_prefix: int
    fallback: bool


def prefix_deltas_of(messages: Iterable[dict], model: ChatModel) -> Iterator[Delta]:
    """For each message of a conversation the tokens it adds.

    A prefix that ends with another role than the assistant's, and goes on, ends with the generation
    prompt. If the template fails on a prefix, that prefix is read as plain lines.
    """
    encoder, seen, before = PrefixEncoder(model), [], 0
    rest = iter(messages)
    coming = next(rest, None)
    while coming is not None:
        seen.append(coming)
        coming = next(rest, None)
        prompt = seen[-1]["role"] != "assistant" and coming is not None
        try:
            text, failed = model.render(seen, add_generation_prompt=prompt), False
        except Exception:  # whatever a template raises, the conversation keeps its row
            text, failed = plain_lines(seen), True
        ids = encoder.encode(text)
        yield Delta(ids[before:], len(ids), failed)
        before = len(ids)


def tokenize_chat(
    messages: DataFrame, load: Callable[[], ChatModel], keys: Sequence[str] = TRAJECTORY, order: str = "msg_idx"
) -> DataFrame:
    """(keys, order, role, ids, n_prefix, fallback): the tokens each message adds under a model's chat template.

    ``messages(keys, order, role, content)``; null roles and contents count as empty. ``load`` runs once per
    task and returns the model; it and the template must be importable on the executors. Conversations stream
    through their task one after the other; a template sees all messages up to the current one, so a task
    holds one conversation at a time. The rows are those ``adapt_trajectories`` takes.
    """
    rows = messages.select(*keys, order, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    schema = StructType([
        *[rows.schema[c] for c in (*keys, order)], StructField("role", StringType()), StructField("ids", ArrayType(IntegerType())),
        StructField("n_prefix", LongType()), StructField("fallback", BooleanType())])
    arrow, width = to_arrow_schema(schema), len(keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held = []
        for _, own in groupby(rows, key=lambda r: r[:width]):
            known = []

            def said() -> Iterator[dict]:
                for row in own:
                    known.append(row)
                    yield {"role": row[-2], "content": row[-1]}

            for i, delta in enumerate(prefix_deltas_of(said(), model)):
                held.append((*known[i][:-1], delta.ids, delta.n_prefix, delta.fallback))
                if len(held) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(task, schema)
