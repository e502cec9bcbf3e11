"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example is the formatted text of all turns before an assistant turn, then that turn, whose reply alone is trainable
(loss_start, loss_end: code points of the text).  Turns after the last assistant turn come as a last example without a
trainable part, so that nothing of a conversation is lost.

Template: a turn is `[role]text</s>`.  In texts and roles, `\\`, `<`, `[` and `]` are written with a backslash before
them, so no control string can arise inside a text, and reading back undoes it.

A conversation's rows are sorted in a task and stream by; what is held is the formatted prefix of one conversation.  The
expansion itself is quadratic in the turns of a conversation.

Defined cases: a null text or role is empty; turns of one number are ordered by role, then text, and all are kept; null
turns come first; rows with a null conv_id form one conversation; an empty table gives no examples.  Columns besides
conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.llm.common import small_batches, table, written

END = "</s>"
TRAINABLE = "assistant"
#: Characters of examples in one Arrow batch.
BATCH_CHARS = 4 << 20
_SPECIAL = re.compile(r"[\\<\[\]]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[((?:\\.|[^\\\]])*)\]((?:\\.|[^\\<])*)</s>", re.DOTALL)
SCHEMA = "conv_id long, example int, text string, loss_start int, loss_end int"
_ARROW = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])


def escaped(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescaped(r), unescaped(t)) for r, t in _TURN.findall(text)]


def _examples(turns):
    """Examples of the turns (conv_id, role, text) of consecutive conversations."""
    conv, prefix, number, open_ = object(), [], 0, 0
    size = 0

    def rest():
        if open_:
            yield conv, number, "".join(prefix), size, size

    for c, role, text in turns:
        if c != conv:
            yield from rest()
            conv, prefix, number, open_, size = c, [], 0, 0, 0
        mark, body = f"[{escaped(role)}]", escaped(text)
        start = size + len(mark)
        prefix.append(f"{mark}{body}{END}")
        size = start + len(body) + len(END)
        open_ += 1
        if role == TRAINABLE:
            yield conv, number, "".join(prefix), start, start + len(body)
            number, open_ = number + 1, 0
    yield from rest()


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end."""
    small_batches(conversations.sparkSession)

    def expand(batches):
        def turns():
            for batch in batches:
                yield from zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)

        group, size = [], 0
        for e in _examples(turns()):
            group.append(e)
            size += len(e[2])
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*group, strict=True), _ARROW, strict=True)], schema=_ARROW)
                group, size = [], 0
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*group, strict=True), _ARROW, strict=True)], schema=_ARROW)

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(expand, SCHEMA)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples say, read back: per conversation its turns, its trainable text and the size of its examples."""

    def digest(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in ("conv_id", "text", "loss_start", "loss_end")), strict=True)

        def summed(conv, last, loss, n_loss, chars):
            turns = parsed(last)
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            return conv, len(turns), sha, n_loss, loss.hexdigest(), chars

        out, conv, last, loss, n_loss, chars = [], None, None, None, 0, 0
        for c, text, a, b in rows():
            if last is None or c != conv:
                if last is not None:
                    out.append(summed(conv, last, loss, n_loss, chars))
                conv, loss, n_loss, chars = c, hashlib.sha256(), 0, 0
            reply = unescaped(text[a:b])
            loss.update(reply.encode())
            n_loss += len(reply)
            chars += len(text)
            last = text
        if last is not None:
            out.append(summed(conv, last, loss, n_loss, chars))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*out, strict=True) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    ordered = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(written(format_conversations(turns.union(probe)), "chat"))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length('[' || regexp_replace(role, '([\\<\[\]])', '\\\1', 'g') || ']' || regexp_replace(text, '([\\<\[\]])', '\\\1', 'g') || '</s>') AS n FROM t),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
             count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (coalesce(sum(upto) FILTER (role = 'assistant'), 0) + coalesce(max(upto) FILTER (back = 1 AND role <> 'assistant'), 0))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
