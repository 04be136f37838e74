"""Chat formatting by event-sourced reconstruction.

A log of events is folded into final messages, message by message: a whole message, an edit or a regeneration
starts the text anew, streamed deltas append to it, a deletion removes the message. Messages are then dealt by
conversation, sorted by position and rendered with a template that marks turns and escapes control strings
inside texts reversibly.

Grouping is by (conversation, message), so a conversation with a third of all events is spread over tasks while
it is folded. Only the final rendering needs a conversation in one task, in order; it streams rows one Arrow
batch at a time and keeps nothing of what it has passed but a digest. Output is one row per turn, never one
string per conversation.

Defined results: a null text is empty, a null role is the empty role, null conversation, turn or sequence
numbers sort first; events without a message id are whole messages by themselves, whatever their kind (null
included; a regeneration is empty, a deletion is none), so repeated rows are repeated turns; an event of a message that is
delivered again (equal in all columns) counts once; ties in sequence are ordered by part, kind, role and text; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.frames import NO_ID, arrays_of

#: Control strings, own and of other common templates, that must not appear inside a text as they are.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"
#: The role whose text is trained on.
LOSS_ROLE = "assistant"


def escape_pattern(marks: tuple[str, ...] = CONTROL) -> str:
    """Matches first character, backslashes and remainder of a control string; one more backslash hides it."""
    rest: dict[str, list[str]] = {}
    for m in marks:
        rest.setdefault(m[0], []).append(re.escape(m[1:]))
    return "|".join(rf"{re.escape(c)}\\*(?={'|'.join(r)})" for c, r in rest.items())


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({escape_pattern()})", r"$1\\")


def unescape(text: str) -> str:
    return _HIDDEN.sub(lambda m: m[0][:-1], text)


_HIDDEN = re.compile(escape_pattern().replace(r"\\*", r"\\+"))


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id, position, seq, role, text`` of the final messages.

    ``events`` has ``conv_id, seq, kind, message_id, role, text`` and may have ``part``, the order of events with one ``seq``. Kinds: ``message`` and ``edit`` set the text,
    ``regenerate`` empties it for the deltas that follow, ``delta`` appends, ``delete`` removes the message. A
    message stands where its first event stood and has the role that its events last named.
    """
    part = F.col("part").cast("long") if "part" in events.columns else F.lit(0).cast("long")
    rows = events.withColumns({"text": F.coalesce(F.col("text"), F.lit("")), "part": part})
    alone = rows.filter("message_id IS NULL AND NOT kind <=> 'delete'")
    text = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    whole = alone.select("conv_id", F.col("seq").alias("position"), "role", text.alias("text"))
    parts = rows.filter("message_id IS NOT NULL").withColumn("at", F.struct("seq", "part", "kind", "role", "text"))
    key = ["conv_id", "message_id"]
    ends = parts.groupBy(*key).agg(
        F.min("seq").alias("position"),
        F.max(F.when(F.col("kind") != "delta", F.col("at"))).alias("anew"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role"))).getField("role").alias("last_role"),
    )
    ends = ends.withColumnsRenamed({"conv_id": "_conv", "message_id": "_message"})
    same = parts["conv_id"].eqNullSafe(ends["_conv"]) & (parts["message_id"] == ends["_message"])
    live = parts.join(ends, same).filter("anew IS NULL OR (at >= anew AND anew.kind <> 'delete')")
    piece = F.struct("seq", "part", "kind", "role", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text")).alias("text"))
    folded = live.groupBy(*key).agg(
        F.first("position").alias("position"), F.first("last_role").alias("role"), F.array_sort(F.collect_set(piece)).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return whole.unionByName(folded.select("conv_id", "position", "role", text.alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, position, formatted, loss_start, loss_length`` per turn.

    The loss span, in code points of ``formatted``, covers the escaped text of an assistant turn (0 for other
    roles). Backslashes and line ends in role names are escaped as ``\\\\`` and ``\\n``.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    safe = escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    head, body = F.concat(F.lit(START), safe, F.lit("\n")), escaped(F.coalesce(F.col("text"), F.lit("")))
    trained = role == LOSS_ROLE
    return messages.select(
        "conv_id", "position", F.concat(head, body, F.lit(END)).alias("formatted"),
        F.when(trained, F.char_length(head)).otherwise(0).alias("loss_start"),
        F.when(trained, F.char_length(body)).otherwise(0).alias("loss_length"),
    )


def in_order(turns: DataFrame) -> DataFrame:
    """Rendered turns dealt by conversation and sorted by position within it."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "position", "formatted")


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    if not (formatted.startswith(START) and formatted.endswith(END)):
        raise ValueError("not a rendered turn")
    role, _, body = formatted[len(START) : len(formatted) - len(END)].partition("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(body)


def digests(turns: DataFrame) -> DataFrame:
    """Read rendered turns back: counts and digests per conversation."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close():
            turn_count, chars, loss_count, all_turns, loss = state
            done.append((None if now == NO_ID else now, turn_count, all_turns.hexdigest(), loss_count, loss.hexdigest(), chars))

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")]
            for conv, formatted, start, length in zip(*columns):
                conv = NO_ID if conv is None else conv
                if conv != now:
                    if state:
                        close()
                    now, state = conv, [0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                role, text = read_turn(formatted)
                loss = unescape(formatted[start : start + length])
                state[0] += 1
                state[1] += len(formatted)
                state[2] += len(loss)
                state[3].update(f"{role}\n{text}\n".encode())
                state[4].update(loss.encode())
            if done:
                yield _rows(done)
                done.clear()
        if state:
            close()
            yield _rows(done)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_order(turns).mapInArrow(read, schema)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return arrays_of(**{n: pa.array(v, t) for n, t, v in zip(names, types, zip(*done))})


#: Code points of a streamed piece, and the most pieces of one turn.
DELTA, DELTAS = 256, 64


def from_turns(conversations: DataFrame) -> DataFrame:
    """A plain table ``conv_id, turn, role, text`` as the log of events that would have led to it.

    Every row is a message of its own: opened, then streamed in pieces cut at fixed places. By a hash of conversation and turn, a quarter of
    them have a draft that is regenerated, a quarter another text that an edit replaces, and a quarter pieces that are delivered twice.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message_id"),
    )
    length = F.char_length("text")
    step = F.greatest(F.lit(DELTA), F.ceil(length / DELTAS)).cast("int")
    rows = rows.withColumns({"way": F.pmod(F.xxhash64("conv_id", "seq"), F.lit(4)), "step": step, "n": F.ceil(length / step).cast("int")})

    def event(part: Column | int, kind: str, text: Column, role: Column | None = None) -> Column:
        part = F.lit(part) if isinstance(part, int) else part
        role = F.lit(None).cast("string") if role is None else role
        return F.struct(part.cast("long").alias("part"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    def streamed(text: Column, first: int) -> Column:
        piece = lambda i: event(i + first, "delta", F.substring(text, i * F.col("step") + 1, F.col("step")))
        return F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1), piece)).otherwise(F.array().cast(_EVENTS))

    other, behind = F.reverse("text"), 2 + DELTAS
    draft = F.concat(streamed(other, 1), F.array(event(1 + DELTAS, "regenerate", F.lit(""))), streamed(F.col("text"), behind))
    edited = F.concat(streamed(other, 1), F.array(event(behind, "edit", F.col("text"))))
    plain = streamed(F.col("text"), 1)
    log = F.when(F.col("way") == 0, draft).when(F.col("way") == 1, edited).when(F.col("way") == 2, F.concat(plain, plain)).otherwise(plain)
    opened = F.array(event(0, "message", F.lit(""), F.col("role")))
    return rows.select("conv_id", "seq", "message_id", F.explode(F.concat(opened, log)).alias("e")).select("conv_id", "seq", "message_id", "e.*")


_EVENTS = "array<struct<part:bigint,kind:string,role:string,text:string>>"
