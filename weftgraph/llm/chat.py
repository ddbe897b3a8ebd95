r"""Chat formatting with a grammar round trip.

    chat := turn*
    turn := "<|im_start|>" role "\n" content "<|im_end|>\n"

Conversations are rendered raw, parsed again by a deterministic parser, and compared turn by turn with
their source; a turn that doesn't come back is rendered escaped, and the whole is parsed again, until
all turns are identical. Escaping puts one backslash more into every ``<\...|`` of the content (so
that markers in it are none) and, in roles, spells backslash, newline and bar ``\\``, ``\n``, ``\p``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"
Turn = tuple[str, str]
_BARE, _SLASHED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_OUT, _ROLE_BACK = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}, {"\\": "\\", "n": "\n", "p": "|"}


class Unparsable(ValueError):
    pass


def render_turn(turn: Turn, escaped: bool) -> str:
    role, content = turn
    if escaped:
        if not _role_is_plain(role):
            role = "".join(_ROLE_OUT.get(c, c) for c in role)
        if not _content_is_plain(content):
            content = _BARE.sub(r"<\1\\|", content)
    return f"{START}{role}\n{content}{END}\n"


def _role_is_plain(role: str) -> bool:
    return not ("\\" in role or "\n" in role or START in role or END in role)


def _content_is_plain(content: str) -> bool:
    return not (START in content or END in content or _SLASHED.search(content))


def _unescape_role(role: str) -> str:
    out, i = [], 0
    while i < len(role):
        if role[i] == "\\":
            if role[i + 1 : i + 2] not in _ROLE_BACK:
                raise Unparsable("dangling backslash in a role")
            out.append(_ROLE_BACK[role[i + 1]])
            i += 2
        else:
            out.append(role[i])
            i += 1
    return "".join(out)


def parse(text: str) -> list[Turn]:
    """The turns of a rendered chat; raises Unparsable for what the grammar doesn't derive."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise Unparsable(f"no turn begins at {at}")
        at += len(START)
        line = text.find("\n", at)
        end = text.find(END, at)
        if line < 0 or end < line:
            raise Unparsable(f"no role line at {at}")
        role, content = text[at:line], text[line + 1 : end]
        if START in role or START in content:
            raise Unparsable(f"a turn inside the turn at {at}")
        at = end + len(END)
        if text[at : at + 1] != "\n":
            raise Unparsable(f"no newline at {at}")
        at += 1
        turns.append((_unescape_role(role), _SLASHED.sub(r"<\1|", content)))
    return turns


def _comes_back(rendered: str, turn: Turn) -> bool:
    try:
        return parse(rendered) == [turn]
    except Unparsable:
        return False


def format_turns(turns: list[Turn]) -> tuple[str, int, bool]:
    """Rendered text, number of escaped turns, and whether the whole text gives the turns back."""
    escaped = [False] * len(turns)
    while True:
        parts = [render_turn(t, e) for t, e in zip(turns, escaped, strict=True)]
        text = "".join(parts)
        try:
            if parse(text) == turns:
                return text, sum(escaped), True
        except Unparsable:
            pass
        clash = [i for i, (p, t) in enumerate(zip(parts, turns, strict=True)) if not escaped[i] and not _comes_back(p, t)]
        if not clash:
            return text, sum(escaped), False
        for i in clash:
            escaped[i] = True


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_escaped, round_trip, text), one row a conversation.

    Turns are ordered by turn, role, text, nulls first; repeated rows stay as turns of their own.
    Defined cases: rows with a null conv_id belong to no conversation and are left out; a null role
    reads "unknown", a null text is an empty turn; other columns are dropped; an empty table gives
    an empty result.
    """
    grouped = (
        conversations.where(F.col("conv_id").isNotNull())
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            "conv_id",
            F.transform("turns", lambda t: F.coalesce(t["role"], F.lit("unknown"))).alias("roles"),
            F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))).alias("texts"),
        )
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                format_turns(list(zip(roles, texts, strict=True)))
                for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            sizes = [len(r) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int32()), pa.array([d[1] for d in done], pa.int32()),
                    pa.array([d[2] for d in done], pa.bool_()), pa.array([d[0] for d in done], pa.string()),
                ],
                names=["conv_id", "n_turns", "n_escaped", "round_trip", "text"],
            )

    return grouped.mapInArrow(render, "conv_id long, n_turns int, n_escaped int, round_trip boolean, text string")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(common.table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT *, regexp_matches(role, '\\|\n|<\|im_start\|>|<\|im_end\|>') AS cr, regexp_matches(text, '<\|im_start\|>|<\|im_end\|>|<\\+\|') AS ct FROM t),
e AS (SELECT *, CASE WHEN cr THEN replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p') ELSE role END AS er,
        CASE WHEN ct THEN regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') ELSE text END AS et FROM m)
SELECT conv_id, count(*)::INTEGER AS n_turns, sum((cr OR ct)::INTEGER)::INTEGER AS n_escaped, true AS round_trip,
  string_agg('<|im_start|>' || er || chr(10) || et || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS text
FROM e GROUP BY conv_id"""

QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {"op9_chat_format": ORACLE}
