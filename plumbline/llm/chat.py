"""Conversations as training text, with a loss mask over tokens that is aligned by offsets.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of the turns
to learn are met with the tokens' spans by binary search. Control strings are single tokens,
so no token straddles a turn's edge, and a text that holds one is escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import scratch
from plumbline.llm.common import picked

LEARNED = "assistant"
#: Opening and closing string by role; any other role is written out between ROLE marks.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE = ("[ROLE]", "[/ROLE]")
TURN_END = "[/TURN]"
CONTROL = [*(m for pair in MARKS.values() for m in pair), *ROLE, TURN_END]
#: What the tokenizer itself would take for a control token must not come from a text either.
FOREIGN = ["<|endoftext|>"]
FOUND = re.compile("|".join(re.escape(c) for c in sorted([*CONTROL, *FOREIGN], key=len, reverse=True)))
SPLIT = re.compile("(" + "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)) + ")")
#: Characters of conversations that are encoded together.
TOGETHER = 1 << 20


def escaped(text: str) -> str:
    r"""Backslashes doubled, and one put after the first sign of each control string."""
    return FOUND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of the texts to learn within it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        if role in MARKS:
            opening, closing = MARKS[role]
        else:
            opening, closing = ROLE[0] + escaped(role) + ROLE[1], TURN_END
        body = escaped(text)
        if role == LEARNED:
            spans.append((at + len(opening), at + len(opening) + len(body)))
        out += [opening, body, closing]
        at += len(opening) + len(body) + len(closing)
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    parts, turns, i = SPLIT.split(text), [], 0
    roles = {opening: role for role, (opening, _) in MARKS.items()}
    while i + 1 < len(parts):
        opening, role = parts[i + 1], roles.get(parts[i + 1])
        if opening == ROLE[0]:
            role, i = unescaped(parts[i + 2]), i + 2
        if parts[i] != "" and opening != ROLE[0] or role is None:
            raise ValueError("not a rendered conversation")
        turns.append((role, unescaped(parts[i + 2])))
        i += 4
    return turns


def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
    return made


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (start, end) lies in one of the sorted spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    starts, ends = np.array(spans).T
    at = np.searchsorted(starts, offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 1] <= ends[np.maximum(at, 0)]) & (offsets[:, 0] < ends[np.maximum(at, 0)])


def conversations(batches) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """(id, turns) of rows that come sorted by id and turn."""
    current, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if turns and conv != current:
                yield current, turns
                turns = []
            current = conv
            turns.append((role or "", text or ""))
    if turns:
        yield current, turns


def formatted(turns: DataFrame, path: str, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, formatted, ids, loss) of every conversation; ``path`` is a byte-level tokenizer file.

    Turns go by number, then by role and text, so ties and repeated rows have one order; all
    are kept. A null text or role is empty. Rows without conversation id form one conversation
    without id. One conversation is one training text, and is put together in one task.
    """
    wanted = picked(turns, {"conv_id": id_col, "turn": turn_col, "role": role_col, "text": text_col}, {"role": "string", "text": "string"})
    ordered = wanted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    id_type = wanted.select("conv_id").limit(0).toArrow().schema.field(0).type

    def run(batches):
        encoder = tokenizer(path)

        def out(some):
            texts, spans = zip(*(rendered(t) for _, t in some))
            found = encoder.encode_batch(list(texts), add_special_tokens=False)
            loss = [mask(np.array(f.offsets, dtype=np.int64).reshape(-1, 2), s).tolist() for f, s in zip(found, spans)]
            columns = [pa.array([c for c, _ in some], id_type), pa.array(texts, pa.string()), pa.array([f.ids for f in found], pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "ids", "loss"])

        held, size = [], 0
        for conv, turns in conversations(batches):
            held.append((conv, turns))
            size += sum(len(t) for _, t in turns)
            if size > TOGETHER:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return ordered.mapInArrow(run, f"conv_id {dict(wanted.dtypes)['conv_id']}, formatted string, ids array<int>, loss array<boolean>")


def runs(ids: list[int], loss: list[bool]) -> list[list[int]]:
    """Ids under the mask, one list for each unbroken stretch."""
    inside = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(loss, dtype=np.int8), [0]])))
    return [ids[a:b] for a, b in inside.reshape(-1, 2).tolist()]


def digest(output: DataFrame, path: str) -> DataFrame:
    """What the formatted output says: turns parsed from the text, learned text decoded from ids under the mask."""

    def run(batches):
        decoder = tokenizer(path)
        for batch in batches:
            rows = []
            for text, ids, loss in zip(*(batch.column(c).to_pylist() for c in ("formatted", "ids", "loss"))):
                turns = parsed(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                learned = "".join(map(unescaped, decoder.decode_batch(runs(ids, loss), skip_special_tokens=False)))
                rows.append((len(turns), said, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return output.mapInArrow(run, f"conv_id {dict(output.dtypes)['conv_id']}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op7_chat(spark, sf: str) -> DataFrame:
    import public_tokenizers

    given = spark.read.parquet(f"{sf}/conversations.parquet")
    control = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    path, out = public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "chat")
    formatted(given.select("conv_id", "turn", "role", "text").unionByName(hard), path).write.parquet(out)
    return digest(spark.read.parquet(out), path)
