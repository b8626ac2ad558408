"""Chat formatting by event-sourced reconstruction.

A log has events (conv_id, message, seq, kind, role, text); a message is known by
its turn and its number among those of one turn. Events of a message are folded in
order of seq: `start` opens it and sets the role, `delta` adds text, `edit` replaces
the text so far, `regenerate` empties it, `retract` removes the message. Messages
are rendered by a template and written; a loss mask covers the assistant's texts.
Reading back parses the template and takes the escapes out.

    <turn role="ROLE">
    TEXT
    </turn>

In role and text, a backslash, <, > and " stand behind a backslash.

Defined cases: null text is empty, a null role is empty; rows of a conversation
go by turn, null first, then role and a hash of the text; repeated rows are messages
of their own; a null conv_id is a conversation; a very long text has more and longer
deltas; an event that was delivered again, of the same message and seq, counts once. A long conversation is folded by message; it is only read back in one task,
where it streams by, as its digests run over all of it. An empty log gives no row.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

EVENTS = "conv_id long, message struct<turn:long,k:long>, seq long, kind string, role string, text string"
HEAD, BETWEEN, FOOT = '<turn role="', '">\n', "\n</turn>\n"
_ESCAPE, _BARE = re.compile(r"\\(.)", re.DOTALL), re.compile(r'[\\<>"]')
#: Code points whose escapes are taken out at once.
CHUNK = 1 << 20


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\<>"]', r"\\$0")


def plain(text: str, start: int, stop: int) -> Iterator[str]:
    """The text between two places without its escapes, in parts; ValueError where a control character stands without one."""
    while start < stop:
        end = min(stop, start + CHUNK)
        run = end
        while run > start and text[run - 1] == "\\":
            run -= 1
        end += (end - run) % 2  # an escape isn't cut in two
        if end > stop:
            raise ValueError("an escape without its character")
        part = text[start:end]
        if _BARE.search(part):
            if _BARE.search(_ESCAPE.sub("", part)):
                raise ValueError("a control character without escape")
            part = _ESCAPE.sub(r"\1", part)
        yield part
        start = end


def parts_of(piece: str) -> tuple[str, int, int]:
    """A piece's role, and where its text begins and ends. Escaped text never holds the strings around it."""
    between = piece.find(BETWEEN)
    if not piece.startswith(HEAD) or between < 0 or not piece.endswith(FOOT) or between + len(BETWEEN) > len(piece) - len(FOOT):
        raise ValueError("no piece of the template")
    return "".join(plain(piece, len(HEAD), between)), between + len(BETWEEN), len(piece) - len(FOOT)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, k, role, text: k counts the rows of a turn from 0, by role and a hash of the text.

    Repeated rows are one until they are numbered, and a turn with many rows is counted by ranges of the hash.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("text"))
    own = own.withColumn("range", F.struct("conv_id", "turn", "role", F.shiftrightunsigned("h", 56).alias("byte")))
    sums = own.groupBy("range").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("range.conv_id", "range.turn").orderBy("range.role", "range.byte").rowsBetween(Window.unboundedPreceding, 0))
    before = sums.select("range", (upto - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy(F.shiftrightunsigned("h", 1), "h", "text").rowsBetween(Window.unboundedPreceding, 0))
    placed = own.withColumn("upto", inside).join(before, "range").withColumn("first", F.col("before") + F.col("upto") - F.col("n"))
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k")
    return placed.select("conv_id", "turn", each, "role", "text")


def log_of(conversations: DataFrame, delta: int = 512, deltas: int = 256) -> DataFrame:
    """The event log of (conv_id, turn, role, text) rows, as a chat service would have written it.

    Texts come in deltas of `delta` code points or more, at most `deltas` of them. By
    crc32 of its key a message of four is plain; one has a draft that is generated again;
    one begins wrongly and is edited; and one follows a message that is retracted.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("conv_id", "turn", "k")))
    rows = numbered(conversations).withColumn("rule", F.crc32(key.cast("binary")) % 4)
    long = F.greatest(F.lit(delta), F.ceil(F.length("text") / deltas).cast("int"))
    rows = rows.withColumn("parts", F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / long).cast("int")), lambda i: F.substring(F.col("text"), i * long + 1, long)))
    event = lambda kind, text, role=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))
    start = event("start", F.lit(None).cast("string"), F.col("role"))
    told = F.transform("parts", lambda p: event("delta", p))
    first, rest = F.element_at("parts", 1), F.slice(told, F.lit(2), F.greatest(F.lit(0), F.size("parts") - 1))
    draft = event("delta", F.concat(F.lit("Draft: "), F.reverse(first)))
    again = F.concat(F.array(start, draft, event("regenerate", F.lit(None).cast("string"))), told)
    edited = F.concat(F.array(start, draft, draft, event("edit", first)), rest)
    events = F.when(F.col("rule") == 1, again).when(F.col("rule") == 2, edited).otherwise(F.concat(F.array(start), told))
    gone = F.array(start, draft, event("retract", F.lit(None).cast("string")))
    message = lambda k: F.struct(F.col("turn").alias("turn"), k.alias("k"))
    one = lambda k, e: F.struct(message(k).alias("message"), e.alias("events"))
    both = F.when(F.col("rule") == 3, F.array(one(-1 - F.col("k"), gone), one(F.col("k"), events))).otherwise(F.array(one(F.col("k"), events)))
    each = rows.select("conv_id", F.explode(both).alias("m")).select("conv_id", "m.message", F.posexplode("m.events").alias("seq", "e"))
    return each.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "e.*")


def folded(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the messages that the events amount to. A long conversation is many groups."""
    e = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    # Events that were delivered again have a seq that was there before; the first by kind, role and text counts.
    again = lambda x, i: x["seq"].isNull() | (i == 0) | ~x["seq"].eqNullSafe(F.get("e", i - 1)["seq"])
    grouped = log.groupBy("conv_id", "message").agg(e.alias("e")).withColumn("e", F.filter("e", again))
    cleared = F.array_max(F.transform(F.filter("e", lambda x: x["kind"].isin("edit", "regenerate")), lambda x: x["seq"]))
    kept = F.filter("e", lambda x: (x["kind"].isin("delta", "edit")) & (F.col("cleared").isNull() | (x["seq"] >= F.col("cleared"))))
    named = F.filter("e", lambda x: x["kind"] == "start")
    gone = F.exists("e", lambda x: x["kind"] == "retract")
    texts = F.array_join(F.transform(kept, lambda x: x["text"]), "")
    return grouped.withColumn("cleared", cleared).where(~gone).select("conv_id", "message", F.coalesce(F.try_element_at(named, F.lit(-1))["role"], F.lit("")).alias("role"), texts.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, message, formatted, loss_from, loss_to: a message's piece of the output and the code points under the loss mask."""
    head = F.concat(F.lit('<turn role="'), escaped(F.col("role")), F.lit('">\n'))
    body = escaped(F.col("text"))
    loss = F.col("role") == "assistant"
    return messages.select("conv_id", "message", F.concat(head, body, F.lit("\n</turn>\n")).alias("formatted"), F.when(loss, F.length(head)).alias("loss_from"), F.when(loss, F.length(head) + F.length(body)).alias("loss_to"))


def digested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of sorted pieces (conv_id, formatted, loss_from, loss_to), which stream by; texts are parsed in parts."""
    open_, conv, turns, n, loss, chars, points = False, None, None, 0, None, 0, 0
    done: list[tuple] = []

    def close() -> None:
        if open_:
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), points))

    for b in it:
        for c, piece, a, z in zip(*(b.column(k) for k in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
            c, text, a, z = c.as_py(), piece.as_py(), a.as_py(), z.as_py()
            if not open_ or c != conv:
                close()
                open_, conv, turns, n, loss, chars, points = True, c, hashlib.sha256(), 0, hashlib.sha256(), 0, 0
            role, start, stop = parts_of(text)
            turns.update(f"{role}\n".encode())
            for part in plain(text, start, stop):
                turns.update(part.encode())
            turns.update(b"\n")
            n, points = n + 1, points + len(text)
            if a is not None:
                for part in plain(text, a, z):
                    chars += len(part)
                    loss.update(part.encode())
        if done:
            yield _rows(done)
            done = []
    close()
    if done:
        yield _rows(done)


def read_back(pieces: DataFrame) -> DataFrame:
    """What the written pieces say about each conversation; they stream by in order, and only sums and digests are held."""
    spread = pieces.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "message")
    return spread.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def formatted(log: DataFrame) -> DataFrame:
    """The training pieces of a log, written: conv_id, message, formatted, loss_from, loss_to."""
    return written(rendered(folded(log)), "chat")
