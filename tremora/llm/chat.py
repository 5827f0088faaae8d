"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn into one text with ordered placeholders for attachments, and records the
references and the tokens that they expand to. Every turn becomes one segment of its conversation's text, with marks
around it and control strings inside it escaped so that they can be read back. Segments are made where the turns lie;
the text of a conversation is its segments in order and is never gathered as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tremora.llm.common import small_batches, text_of

#: Fixed values of the template: what stands before the role, after it, and after the text.
OPEN, TURN, CLOSE = "<s>[INST] ", "\n", " [/INST]</s>"
#: Where a control string or a placeholder could begin.
ANGLE, SQUARE = r"<(?=/?s>|\|)", r"\[(?=/?INST\])"
#: Tokens for a unit of each kind of attachment: an image tile, a second of sound, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 1024}
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escaped(text: Column) -> Column:
    """text without control strings; each backslash left starts one of the pairs that unescaped() knows."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.regexp_replace(text, ANGLE, r"\\l")
    return F.regexp_replace(text, SQUARE, r"\\i")


def unescaped(text: str) -> str:
    return text.replace("\\n", "\n").replace("\\l", "<").replace("\\i", "[").replace("\\b", "\\")


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its turn."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            none.cast("string").alias("ref"),
            none.cast("long").alias("units"),
        )
    ).cast(PARTS)


def flattened(parts: Column, unit_tokens: dict[str, int] = UNIT_TOKENS) -> tuple[Column, Column]:
    """(text, attachments) of an array of parts. Texts are escaped and joined as they stand; every other part becomes
    <|kind:n|>, where n counts the attachments of the turn, and an attachment (n, kind, ref, tokens). An attachment of
    unknown kind has no tokens; a null kind or a null part counts as an empty text."""
    visible = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p["kind"].isNotNull())
    others = F.filter(visible, lambda p: p["kind"] != "text")
    tokens = F.create_map(*(F.lit(x) for item in unit_tokens.items() for x in item))
    attachments = F.transform(
        others,
        lambda p, i: F.struct(
            (i + 1).alias("n"),
            p["kind"].alias("kind"),
            p["ref"].alias("ref"),
            (F.coalesce(F.try_element_at(tokens, p["kind"]), F.lit(0)) * F.coalesce(p["units"], F.lit(1)))
            .cast("long")
            .alias("tokens"),
        ),
    )
    text = F.aggregate(
        visible,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("n")),
        lambda acc, p: F.when(
            p["kind"] == "text",
            F.struct(F.concat(acc["text"], escaped(F.coalesce(p["text"], F.lit("")))).alias("text"), acc["n"].alias("n")),
        ).otherwise(
            F.struct(
                F.concat(acc["text"], F.lit("<|"), escaped(p["kind"]), F.lit(":"), (acc["n"] + 1).cast("string"), F.lit("|>")).alias("text"),
                (acc["n"] + 1).alias("n"),
            )
        ),
        lambda acc: acc["text"],
    )
    return text, attachments


def format_turns(
    turns: DataFrame,
    parts: Column | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(conv_id, turn, role, segment, loss_start, loss_end, attachments, expanded_tokens), a row for each turn.

    parts is a column of typed parts (see PARTS); without it the text column is the only part. loss_start and loss_end
    are character offsets within the segment of what loss_role says, equal for other roles. Null roles and texts count
    as empty, null turns come first, and turns of equal number go by role and text; repeated rows are turns of their
    own. Rows without conv_id form one conversation. Other columns aren't read; an empty table gives an empty result.
    """
    text, attachments = flattened(text_parts(text_of(text_col)) if parts is None else parts)
    role = F.replace(escaped(text_of(role_col)), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit(TURN))
    made = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        text_of(role_col).alias("role"),
        head.alias("head"),
        text.alias("body"),
        attachments.alias("attachments"),
    )
    learned = F.when(F.col("role") == loss_role, F.length("body")).otherwise(F.lit(0))
    return made.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", "body", F.lit(CLOSE)).alias("segment"),
        F.length("head").alias("loss_start"),
        (F.length("head") + learned).alias("loss_end"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def in_order(segments: DataFrame) -> DataFrame:
    """Segments dealt out by conversation and sorted within; nothing is gathered, tasks read them as a stream."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")


SUMMARY = (
    "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long,"
    " n_attachments long, expanded_tokens long"
)


def read_back(segments: DataFrame) -> DataFrame:
    """One row for each conversation, parsed from its segments: roles, texts and what is under the loss mask.

    A digest of a whole conversation is one sequential stream, so a task holds a running hash and a batch of segments,
    whatever the length of the conversation. Ids may be of any simple type; no segments give no rows.
    """

    def parse(segment: str) -> tuple[str, str]:
        role, _, body = segment.removeprefix(OPEN).removesuffix(CLOSE).partition(TURN)
        return unescaped(role), unescaped(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current, state = None, None

        def close() -> None:
            turns, loss, n, chars, total, attached, tokens = state
            done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), total, attached, tokens))

        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end", "n_attachments", "expanded_tokens")]
            for conv, segment, start, end, attached, tokens in zip(*rows, strict=True):
                if state is None or conv != current:
                    if state is not None:
                        close()
                    current, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0]
                role, text = parse(segment)
                state[0].update(f"{role}\n{text}\n".encode())
                learned = unescaped(segment[start:end])
                state[1].update(learned.encode())
                state[2:] = [
                    state[2] + 1,
                    state[3] + len(learned),
                    state[4] + len(segment),
                    state[5] + attached,
                    state[6] + tokens,
                ]
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if state is not None:
            close()
        if done:
            yield batch_of(done)

    chosen = segments.select(
        "conv_id", "turn", "role", "segment", "loss_start", "loss_end", F.size("attachments").alias("n_attachments"), "expanded_tokens"
    )
    kind = segments.schema["conv_id"].dataType.simpleString()
    arrow = to_arrow_type(segments.schema["conv_id"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
    types = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    small_batches(segments.sparkSession)
    return in_order(chosen).mapInArrow(run, SUMMARY.format(kind=kind))


def digest(conversations: DataFrame) -> DataFrame:
    """The summary of all conversations and of conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(turns))
