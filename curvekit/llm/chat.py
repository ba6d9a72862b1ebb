"""Chat formatting: conversations rebuilt from event logs, rendered with reversible escapes and a loss mask."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template: a turn is OPEN, role, line end, text, CLOSE.
OPEN, CLOSE = "### ", "</turn>\n"
TRAINED = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|\n)")
#: One turn of rendered text: everything between the marks is free of control strings that are not escaped.
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|\n)|[^\\\n])*)\n((?:\\(?:\\|###|</turn>)|[^\\<]|<(?!/turn>))*)</turn>\n")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn, and where its text begins and ends (code points)."""
    head, body = f"{OPEN}{escape(role, True)}\n", escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered turns; anything else is an error."""
    out, at = [], 0
    while at < len(rendered):
        turn = _TURN.match(rendered, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        end = turn.end(1)
        out.append((unescape(turn.group(1)), unescape(rendered[end + 1:turn.end() - len(CLOSE)])))
        at = turn.end()
    return out


def as_events(turns: DataFrame) -> DataFrame:
    """The log that leaves the given turns (`conv_id, turn, role, text`) as its final messages: `conv_id, turn, seq, kind, role, text`.

    By the length of its text (mod 4) a turn is said at once, streamed in two deltas, drafted and edited, or drafted, regenerated and streamed again. Rows
    of one turn, equal ones too, are messages of their own, in the order of role and text; the rows of a turn are numbered by one window. Null roles and
    texts count as empty. Other columns are not looked at. Empty tables give an empty log.
    """
    said = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = said.withColumn("_no", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).cast("bigint"))
    half = F.expr("length(text) div 2")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def log(*events: tuple) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), (F.col("role") if k == 0 else F.lit(None).cast("string")).alias("role"), body.alias("text"))
                         for k, (kind, body) in enumerate(events)])

    nothing, way = F.lit(""), F.length("text") % 4
    events = (F.when(way == 0, log(("message", F.col("text")))).when(way == 1, log(("message", nothing), ("delta", head), ("delta", tail)))
              .when(way == 2, log(("message", tail), ("edit", F.col("text"))))
              .otherwise(log(("message", nothing), ("delta", tail), ("regenerate", nothing), ("delta", head), ("delta", tail))))
    one = said.select("conv_id", "turn", "_no", F.explode(events).alias("_e"))
    return one.select("conv_id", "turn", (F.col("_no") * 8 + F.col("_e.step")).alias("seq"), "_e.kind", "_e.role", "_e.text")


def rebuild(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq", turn_col: str = "turn", kind_col: str = "kind", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Final messages, one row each: `conv_id, no, role, text` (`no` counts from 0 in a conversation) and their rendering: `rendered, loss_from, loss_to`.

    Kinds of events: `message` begins a message with its text, `delta` adds to the message of its turn, `edit` replaces its text, `regenerate` empties it
    for the deltas that follow. Other kinds, and null, count as `message`. A delta, edit or regenerate without a message begins one. Messages stand in
    the order of their turns (null first); the events of a turn are folded by sequence number, ties by kind (message first), role and text. So repeated
    rows of kind `message` are messages of their own, repeated deltas add twice. Null roles and texts count as empty; a role comes from the first event of
    a message that names one. A null conversation is a conversation. Other columns are not looked at. An empty log gives an empty result.

    Logs are partitioned by conversation, sorted, and streamed; a task holds one message at a time, however long the conversation is. `loss_from` and
    `loss_to` are code points within `rendered` and set for the trained role alone.
    """
    c = {k: F.col(f"`{v}`") for k, v in {"conv_id": conv_col, "seq": seq_col, "turn": turn_col, "kind": kind_col, "role": role_col, "text": text_col}.items()}
    kind = F.when(c["kind"].isin("delta", "edit", "regenerate"), c["kind"]).otherwise("message")
    rows = events.select(c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), c["seq"].alias("seq"), kind.alias("kind"),
                         c["role"].cast("string").alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn"), F.col("seq"), F.col("kind") != "message", F.col("kind") != "edit", F.col("kind") != "regenerate", F.col("role"), F.col("text")]
    kind_of = rows.schema["conv_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turn, no, role, parts, begun = None, None, -1, None, [], False

        def done(out: list) -> None:
            body, start, end = render(role or "", "".join(parts))
            trained = role == TRAINED
            out.append((conv, no, role or "", "".join(parts), body, start if trained else None, end if trained else None))

        def batch_of(out: list) -> pa.RecordBatch:
            kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["conv_id", "no", "role", "text", "rendered", "loss_from", "loss_to"])

        id_type = None
        for batch in batches:
            id_type, out = batch.column(0).type, []
            for own, at, what, who, text in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if not begun or own != conv or at != turn or what == "message":
                    if begun:
                        done(out)
                    no = no + 1 if begun and own == conv else 0
                    conv, turn, role, parts, begun = own, at, who, [text], True
                    if what == "regenerate":
                        parts = []
                    continue
                role = role if role is not None else who
                if what == "delta":
                    parts.append(text)
                else:
                    parts = [text] if what == "edit" else []
            if out:
                yield batch_of(out)
        if begun:
            out = []
            done(out)
            yield batch_of(out)

    dealt = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "kind", "role", "text")
    return dealt.mapInArrow(fold, f"conv_id {kind_of}, no bigint, role string, text string, rendered string, loss_from bigint, loss_to bigint")


def read_back(messages: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation, from the rendered turns alone: `n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`.

    `messages` is the result of `rebuild`. Digests are of role, line end, text, line end for each turn, and of all text under the loss mask, unescaped;
    lengths are code points. Turns are streamed in order: a task holds one turn and the digests. `in_order` says that the rows are as `rebuild` leaves
    them, conversation by conversation, so that they need no second shuffle; tables that were written and read again are not.
    """
    rows = messages if in_order else messages.repartition("conv_id").sortWithinPartitions("conv_id", "no")
    rows = rows.select("conv_id", "rendered", "loss_from", "loss_to")
    kind_of = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, id_type = None, False, None
        turns = loss = chars = masked = None
        n = 0

        def batch_of(out: list) -> pa.RecordBatch:
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            id_type, out = batch.column(0).type, []
            for own, rendered, start, end in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if not begun or own != conv:
                    if begun:
                        out.append((conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
                    conv, begun, n, chars, masked = own, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(rendered):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                chars += len(rendered)
                if start is not None:
                    text = unescape(rendered[start:end])
                    loss.update(text.encode())
                    masked += len(text)
            if out:
                yield batch_of(out)
        if begun:
            yield batch_of([(conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars)])

    return rows.mapInArrow(run, f"conv_id {kind_of}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
