"""Chat formatting by token-level assembly.

Each text is encoded on its own, so no token reaches over a turn's edge; reserved ids
(beyond the vocabulary) for the control strings are spliced around it. The loss mask
is the running sum of +1 and -1 marks at the edges of assistant texts, and a turn's
place in its conversation is the running sum of the turns' lengths.

Template, for each turn: the role's mark, the text, the end mark. As text:

    ### User: Hello</turn>\\n### Assistant: Hi</turn>\\n

A role without a mark of its own is written as ``### Role: name### Text: ...``. Control strings
occurring in a text are escaped so that the formatted text can be read back too: n
backslashes before one become 2n + 1, n at the end of a text become 2n; an odd number
before a control string means that it is part of the text.

Encoding is row by row, before rows are shuffled. A conversation is then streamed,
turn by turn, through one task sorted by turn: a turn is held at a time, never
a conversation, however long it is. (A digest over a whole conversation can't be split.)
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SLICE_ROWS, col, map_arrow

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that splits text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Reserved ids follow the vocabulary in this order.
CONTROLS = {"user": "### User: ", "assistant": "### Assistant: ", "system": "### System: ", "tool": "### Tool: ", "\0role": "### Role: ", "\0text": "### Text: ", "\0end": "</turn>\n"}
#: What is escaped in texts: the control strings; the end mark also without its line break.
_ESCAPE = re.compile(r"(?<!\\)\\*(?=### (?:User|Assistant|System|Tool|Role|Text): |</turn>|\Z)")
_UNESCAPE = re.compile(r"(\\+)(### (?:User|Assistant|System|Tool|Role|Text): |</turn>|\Z)")


def escape(text: str) -> str:
    """Doubles backslashes before control strings and the end, and adds one before a control string."""
    return _ESCAPE.sub(lambda m: m[0] * 2 + ("" if m.end() == len(text) else "\\"), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


class Codec:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.controls = {role: len(ranks) + i for i, role in enumerate(CONTROLS)}
        self.bytes = {i: b for b, i in ranks.items()}
        self.names = {i: role for role, i in self.controls.items()}

    def encode(self, text: str) -> list[int]:
        """Ids of an escaped text; control strings in it are ordinary text."""
        return self.encoding.encode_ordinary(text)

    def text(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of a turn and the span of its text among them."""
        c = self.controls
        head = [c[role]] if role in CONTROLS and role[:1] != "\0" else [c["\0role"], *self.encode(escape(role)), c["\0text"]]
        body = self.encode(escape(text))
        return [*head, *body, c["\0end"]], len(head), len(head) + len(body)

    def read(self, ids: list[int]) -> list[tuple[str, str]]:
        """(role, text) of each turn of a token sequence."""
        out, role, held = [], "", []
        for i in ids:
            name = self.names.get(i)
            if name is None:
                held.append(i)
            elif name == "\0text":
                role, held = unescape(self.text(held)), []
            elif name == "\0end":
                out.append((role, unescape(self.text(held))))
                held = []
            else:
                role, held = name, []
        return out

    def render(self, ids) -> str:
        """The formatted text."""
        return b"".join(self.bytes[i] if i in self.bytes else CONTROLS[self.names[i]].encode() for i in ids).decode("utf-8")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def read_text(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the formatted text alone."""
    marks = re.compile(r"(?<!\\)((?:\\\\)*)(### (?:User|Assistant|System|Tool|Role|Text): |</turn>\n)")
    out, role, at, kind = [], "", 0, None
    for m in marks.finditer(formatted):
        body, mark = formatted[at : m.end(1)], m[2]
        if mark == CONTROLS["\0text"]:
            role = unescape(body)
        elif mark == CONTROLS["\0end"]:
            out.append((role if kind is None else kind, unescape(body)))
        kind = next((r for r, c in CONTROLS.items() if c == mark and r[0] != "\0"), None)
        at = m.end()
    return out


def format_turns(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", ranks_path: str = DEFAULT_RANKS
) -> DataFrame:
    """One row for each turn, sorted by conversation and turn within its partition: conv, position
    (0, 1, ... in the conversation), ids, mask (one 0 or 1 for each id), token_start (where its ids begin in the
    conversation's sequence).

    Null roles and texts are empty. Turns are ordered by number, nulls first, ties by role,
    then text; repeated rows are turns of their own. Rows with a null conversation are one conversation. An
    empty table gives no rows.
    """

    def make():
        c = codec(ranks_path)

        def step(roles, texts):
            got = [c.turn(r or "", t or "") for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)]
            cuts = np.cumsum([0] + [len(x[0]) for x in got])
            ids = pa.array(np.fromiter(chain.from_iterable(x[0] for x in got), np.int32, int(cuts[-1])))
            return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids), pa.array([x[1] for x in got], pa.int32()), pa.array([x[2] for x in got], pa.int32())]

        return step

    plain = turns.select(col(conv_col).alias("conv"), col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    fields = [("ids", T.ArrayType(T.IntegerType())), ("a", T.IntegerType()), ("b", T.IntegerType())]
    encoded = map_arrow(plain, [F.col("role"), F.col("text")], ["conv", "turn", "role", "text"], fields, make)
    dealt = encoded.repartition(F.col("conv")).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    slim = dealt.select("conv", (F.col("role") == loss_role).alias("loss"), "ids", "a", "b")
    schema = T.StructType([slim.schema["conv"], T.StructField("position", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.ByteType())), T.StructField("token_start", T.LongType())])

    def splice(batches):
        now, position, start = object(), 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                convs, ids = b.column(0).to_pylist(), b.column(2)
                sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
                cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                marks = np.zeros(int(cuts[-1]) + 1, dtype=np.int8)
                loss = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                heads, tails = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
                np.add.at(marks, (cuts[:-1] + heads)[loss], 1)
                np.add.at(marks, (cuts[:-1] + tails)[loss], -1)
                mask = np.cumsum(marks[:-1], dtype=np.int8)
                places, starts = [], []
                for conv, n in zip(convs, sizes.tolist(), strict=True):
                    if conv != now:
                        now, position, start = conv, 0, 0
                    places.append(position)
                    starts.append(start)
                    position, start = position + 1, start + n
                offsets = pa.array(cuts, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.int64()), ids, pa.ListArray.from_arrays(offsets, pa.array(mask)), pa.array(starts, pa.int64())], names=["conv", "position", "ids", "mask", "token_start"])

    return slim.mapInArrow(splice, schema)


def read_back(formatted: DataFrame, *, conv_col: str = "conv_id", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """Digests of each conversation from the rows of ``format_turns`` as they stand in their partitions: the
    conversation, n_turns, turns_sha256 (role, line break, text, line break for each turn), loss_chars and
    loss_sha256 (unescaped text under the mask), formatted_chars, n_tokens, loss_tokens."""
    rows = formatted.select("conv", "ids", "mask")
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    kinds = [rows.schema["conv"].dataType, T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])

    def run(batches):
        c, now, state, begun, kind = codec(ranks_path), None, None, False, pa.null()
        done: list = []

        def flush():
            arrays = [pa.array([r[0] for r in done], kind)] + [pa.array([r[i] for r in done], pa.string() if i in (2, 4) else pa.int64()) for i in range(1, 8)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def close():
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        for b in batches:
            kind = b.column(0).type
            for conv, ids, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or conv != now:
                    if begun:
                        close()
                    now, begun, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in c.read(ids):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(c.text([i for i, m in zip(ids, mask, strict=True) if m]))
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(c.render(ids))
                state[5] += len(ids)
                state[6] += sum(mask)
            if len(done) >= 1000:
                yield flush()
                done = []
        if begun:
            close()
        if done:
            yield flush()

    return rows.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def format_conversations(turns: DataFrame, **options) -> DataFrame:
    """One row for each conversation, for conversations that fit a row: conv, ids, mask."""
    rows = format_turns(turns, **options)
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("position", "ids", "mask"))).alias("t"))
    return whole.select("conv", F.flatten("t.ids").alias("ids"), F.flatten("t.mask").alias("mask"))
