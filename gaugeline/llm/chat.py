r"""Chat formatting by token-level assembly (operator 10).

Each role and each text is encoded by itself; reserved ids, which no text can produce, are spliced
between; the loss mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends.

A turn reads ``<turn ROLE>TEXT</turn>`` and a line feed.  Within roles and texts a backslash is
doubled and a control string gets a backslash after its first character, so that no control string
occurs in them and a backslash followed by any character always stands for that character.

Turns are ordered by turn, then role and text; nulls come first, and a null role or text is empty.
Rows of a null conv_id form one conversation; repeated rows are separate turns; an empty table gives
an empty result; other columns are not looked at.  Encoding, the costly part, is done where the rows
lie; only then are turns sorted by conversation, and conversations stream through their task, so
a long one needs no more memory than a batch.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, partitions, table
from .tokens import encoder, encoding

#: Reserved ids follow the vocabulary: what opens a turn, what ends its role, what closes it.
OPEN, MIDDLE, CLOSE = 0, 1, 2
SHOWN = ("<turn ", ">", "</turn>\n")
CONTROL = ("<turn ", "</turn>", "### Assistant:", "### User:", "### System:", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

TURNS = "conv_id long, position long, start long, input_ids array<int>, loss_mask array<tinyint>"


def escape(text: str, more: str = "") -> str:
    text = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))
    for c in more:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(turns: DataFrame, learned: tuple[str, ...] = ("assistant",), path: str | None = None) -> DataFrame:
    """conv_id, position, start (of the turn in its conversation's ids), input_ids, loss_mask.

    A conversation's input_ids are those of its turns in order of position.
    """

    def encode(batches):
        import pyarrow as pa

        with encoding(path) as enc:
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    part = batch.slice(i, 1000)
                    roles = enc.encode([escape(r or "", ">") for r in part.column("role").to_pylist()])
                    texts = enc.encode([escape(t or "") for t in part.column("text").to_pylist()])
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "turn", "role", "text_hash")), pa.array(roles, pa.binary()), pa.array(texts, pa.binary())], names=["conv_id", "turn", "role", "text_hash", "role_ids", "text_ids"])

    def splice(batches):
        import pyarrow as pa

        base = encoder(path).size
        now, position, start = object(), 0, 0
        for batch in batches:
            rows = [[], [], [], [], []]
            for conv, role, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "role_ids", "text_ids"))):
                if conv != now:
                    now, position, start = conv, 0, 0
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                ids = np.concatenate([[base + OPEN], a, [base + MIDDLE], b, [base + CLOSE]]).astype(np.int32)
                change = np.zeros(len(ids) + 1, dtype=np.int8)
                if role in learned:
                    change[len(a) + 2] += 1
                    change[len(a) + 2 + len(b)] -= 1
                for column, value in zip(rows, (conv, position, start, ids, np.cumsum(change[:-1], dtype=np.int8))):
                    column.append(value)
                position, start = position + 1, start + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8())))], names=["conv_id", "position", "start", "input_ids", "loss_mask"])

    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    # ties are ordered by the text; its hash goes along in place of it
    encoded = map_arrow(slim.withColumn("text_hash", F.sha2("text", 256)), encode, "conv_id long, turn long, role string, text_hash string, role_ids binary, text_ids binary")
    ordered = encoded.repartition(partitions(turns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_hash")
    return map_arrow(ordered, splice, TURNS)


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """What the ids and the mask say: a row per conversation.  ``formatted`` must keep its order."""

    def read(batches):
        import pyarrow as pa

        tok, base = encoder(path).tokenizer, encoder(path).size
        text_of = lambda ids: tok.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""
        now, out = None, []

        def ended():
            out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def flush():
            columns = list(zip(*out)) if out else [[]] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return batch

        for batch in batches:
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("input_ids"), batch.column("loss_mask")):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                if now is None or now[0] != conv:
                    if now:
                        ended()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                opens, middles, closes = (np.flatnonzero(ids == base + k) for k in (OPEN, MIDDLE, CLOSE))
                for a, b, c in zip(opens, middles, closes):
                    role, text = text_of(ids[a + 1 : b]), text_of(ids[b + 1 : c])
                    now[1] += 1
                    now[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    now[5] += len(role) + len(text) + sum(map(len, SHOWN))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                for a, b in zip(edges[::2], edges[1::2]):
                    said = unescape(text_of(ids[a:b]))
                    now[3] += len(said)
                    now[4].update(said.encode())
            yield flush()
        if now:
            ended()
        yield flush()

    return map_arrow(formatted, read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def render(ids, path: str | None = None) -> str:
    """The formatted text that ids stand for."""
    tok, base = encoder(path).tokenizer, encoder(path).size
    out, part = [], []
    for i in ids:
        if i >= base:
            out += [tok.decode(part, skip_special_tokens=False) if part else "", SHOWN[i - base]]
            part = []
        else:
            part.append(int(i))
    return "".join(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(assemble(turns.unionByName(extra)))
