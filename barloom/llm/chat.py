"""Conversations as training text that parses back to the same turns.

Grammar: a conversation is a run of turns, a turn is ``### Label: body</turn>`` and a
line end. A body holds neither ``###`` nor ``</turn>``; a backslash in it stands
before a character that is meant literally. Each turn is first rendered as it is and
parsed again. Only where the parser does not give the turn back is its content
escaped, and every finished conversation is parsed once more against its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the template ---------------------------------------------------
MARK = "### "
LABEL_END = ": "
TURN_END = "</turn>"
LINE_END = "\n"
LABELS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
OTHER_ROLE = "role="

LEARNED_ROLE = "assistant"
TURNS_PER_PART = 64


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#/])", r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _label(role: Column) -> Column:
    out = F.concat(F.lit(OTHER_ROLE), F.url_encode(role))
    for name, label in LABELS.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def _role(label: Column) -> Column:
    """The role of a label; null if it is none."""
    given = F.substr(label, F.lit(len(OTHER_ROLE) + 1))
    out = F.when(F.startswith(label, F.lit(OTHER_ROLE)), F.try_url_decode(given))
    for name, text in LABELS.items():
        out = F.when(label == text, F.lit(name)).otherwise(out)
    return out


def _turn_text(role: Column, body: Column) -> Column:
    return F.concat(F.lit(MARK), _label(role), F.lit(LABEL_END), body, F.lit(TURN_END + LINE_END))


def _parse_segment(segment: Column) -> Column:
    """(role, text) of what stands before a turn's end; null where the grammar is broken."""
    head = F.substring_index(segment, LABEL_END, 1)
    role = _role(F.substr(head, F.lit(len(MARK) + 1)))
    body = F.substr(segment, F.length(head) + len(LABEL_END) + 1)
    broken = (
        ~F.startswith(head, F.lit(MARK))
        | ~F.startswith(segment, F.concat(head, F.lit(LABEL_END)))
        | F.contains(body, F.lit(MARK.strip()))
        | F.contains(body, F.lit(TURN_END))
        | role.isNull()
    )
    return F.when(~broken, F.struct(role.alias("role"), _unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    segments = F.split(formatted, TURN_END + LINE_END, -1)
    whole = F.slice(segments, 1, F.size(segments) - 1)
    return F.transform(whole, _parse_segment)


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """(conv_id, part, formatted, turns, loss_spans) of every conversation.

    Turns are ordered by ``turn``, then role, then text; a null turn comes first. A long
    conversation is cut into parts by turn number, so one cell stays small unless
    very many rows share a turn. Null roles and texts are empty. Rows with a null
    conversation form one conversation, repeated rows are repeated turns, an empty
    table gives no rows, and other columns are ignored. ``loss_spans`` are the code
    point ranges (start, end) of the assistant's bodies in ``formatted``.
    """
    empty = F.lit("")
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
    )
    plain = _turn_text(F.col("role"), F.col("text"))
    again = parse(plain)
    same = (F.size(again) == 1) & F.coalesce(again[0] == F.struct("role", "text"), F.lit(False))
    turns = turns.withColumn("body", F.when(same, F.col("text")).otherwise(_escape(F.col("text"))))
    turns = turns.withColumn("piece", _turn_text(F.col("role"), F.col("body")))
    parts = turns.groupBy("conv_id", F.floor(F.col("turn") / turns_per_part).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "body", "piece"))).alias("t")
    )
    formatted = F.array_join(F.transform("t", lambda x: x["piece"]), "")
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    built = parts.select(
        "conv_id",
        "part",
        formatted.alias("formatted"),
        source.alias("source"),
        _loss_spans("t").alias("loss_spans"),
    )
    same = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    proven = F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not parse back: "), F.col("conv_id").cast("string"))).cast("string")
    )
    return built.select("conv_id", "part", proven.alias("formatted"), F.size("source").alias("turns"), "loss_spans")


def _loss_spans(turns: str) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(turn["piece"])
        body_end = end - len(TURN_END + LINE_END)
        span = F.struct((body_end - F.length(turn["body"])).alias("start"), body_end.alias("end"))
        grown = F.concat(state["spans"], F.array(span))
        learned = turn["role"] == LEARNED_ROLE
        return F.struct(end.alias("at"), F.when(learned, grown).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def learned_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    cut = F.transform(spans, lambda s: _unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(cut, "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests per conversation, all taken from the formatted text.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). A
    digest runs over a whole conversation, so its text must fit one cell here.
    """
    turns = parse(F.col("formatted"))
    canonical = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = formatted.select(
        "conv_id",
        F.struct(
            "part",
            canonical.alias("canonical"),
            learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
            F.size(turns).cast("bigint").alias("n"),
            F.length("formatted").cast("bigint").alias("chars"),
        ).alias("p"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))

    def text(name: str) -> Column:
        return F.array_join(F.transform("p", lambda x: x[name]), "")

    def total(name: str) -> Column:
        return F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x[name])

    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.encode(text("canonical"), "UTF-8"), 256).alias("turns_sha256"),
        F.length(text("learned")).cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(text("learned"), "UTF-8"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
