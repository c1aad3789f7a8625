"""Chat formatting with a grammar round trip.

Grammar: a conversation is ``<s>`` and turns; a turn is ``[INST]`` role ``[/INST]`` text
``</s>``. These four strings are control tokens. In front of one, a run of 2k+1
backslashes stands for k backslashes and the token's letters as plain text, and a run of
2k for k backslashes and the token itself; elsewhere a backslash is a backslash.

A turn is rendered as it is and parsed again; where the recovered turn differs from the
source, its conflicting content (tokens, and backslashes in front of one) is escaped, until
both are identical. A turn ends where its own ``</s>`` does, so a conversation parses as
its turns do one after another, and a task streams through conversations of any length
with digests as its only state.

Defined results: a null role or text is empty; turns follow their number, nulls first, then
role and text; rows that repeat are turns of their own; a null id is a conversation of its
own; other columns are not used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
#: The role whose texts count for the loss.
LOSS_ROLE = "assistant"
_TOKEN = re.compile(r"(\\*)(<s>|</s>|\[INST\]|\[/INST\])")


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def escape(text: str, last: bool = True) -> str:
    """Plain text with its tokens escaped; `last`: a token follows, so backslashes at the end are doubled."""
    text = _TOKEN.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)
    ending = len(text) - len(text.rstrip("\\"))
    return text + "\\" * ending if last else text


def render_turn(role: str, text: str) -> str:
    return f"{ROLE}{role}{TEXT}{text}{END}"


def parse_turns(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered text without ``<s>``; GrammarError if it is none."""
    turns: list[tuple[str, str]] = []
    want, at, held, role = ROLE, 0, "", ""
    for m in _TOKEN.finditer(rendered):
        held += rendered[at : m.start()] + "\\" * (len(m[1]) // 2)
        at = m.end()
        if len(m[1]) % 2:
            held += m[2]
            continue
        if m[2] != want or want == ROLE and held:
            raise GrammarError(f"{m[2]} at {m.start()}, not {want}")
        if want == TEXT:
            role = held
        elif want == END:
            turns.append((role, held))
        want, held = {ROLE: TEXT, TEXT: END, END: ROLE}[want], ""
    if want != ROLE or at < len(rendered):
        raise GrammarError("it ends inside a turn")
    return turns


def round_trip(role: str, text: str) -> tuple[str, str, str]:
    """(rendered turn, role and text recovered from it), escaping what conflicts until both are the source's."""
    for r, t in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        rendered = render_turn(r, t)
        try:
            turns = parse_turns(rendered)
        except GrammarError:
            continue
        if turns == [(role, text)]:
            return rendered, *turns[0]
    raise GrammarError(f"no rendering of {role!r} and {text[:80]!r} reads back")


def format_conversation(turns: list[tuple[str, str]]) -> str:
    return BEGIN + "".join(round_trip(r, t)[0] for r, t in turns)


def parse_conversation(rendered: str) -> list[tuple[str, str]]:
    if not rendered.startswith(BEGIN):
        raise GrammarError(f"it doesn't begin with {BEGIN}")
    return parse_turns(rendered[len(BEGIN) :])


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; a conversation may go on over batches."""
    done: list[tuple] = []
    current, n, seen, loss, loss_chars, chars = None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def row() -> tuple:
        return current[0], n, seen.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if current != (conv,):
                if current is not None:
                    done.append(row())
                current, n, seen, loss, loss_chars, chars = (conv,), 0, hashlib.sha256(), hashlib.sha256(), 0, len(BEGIN)
            rendered, role, text = round_trip(role, text)
            n, chars = n + 1, chars + len(rendered)
            seen.update(f"{role}\n{text}\n".encode())
            if role == LOSS_ROLE:
                loss.update(text.encode())
                loss_chars += len(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            done = []
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(), _SCHEMA, strict=True)], schema=_SCHEMA)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = (batch.column(i).to_pylist() for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([round_trip(r, t)[0] for r, t in zip(roles, texts, strict=True)], pa.string()), batch.column(2)], names=["conv_id", "turn", "rendered", "role"])


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def rendered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, rendered, role): each turn's text as training reads it; a conversation is ``<s>`` and its turns in order."""
    return _turns(conversations).mapInArrow(_render, "conv_id long, turn long, rendered string, role string")


def format_digests(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its rendered text. A hash of a whole
    conversation has to see its turns one after another: they stream through a sorted
    partition, of which no more than a batch is held."""
    ordered = _turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = _turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return format_digests(turns.union(more))


_HARD = "</s>[INST] ok [/INST]"
ORACLE = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all select * from (values (-1, 0, 'user', '{_HARD}'), (-1, 1, 'assistant', '{_HARD}'))),
e as (select *, 17 + length(role) + length(t) + len(regexp_extract_all(t, '<s>|</s>|\[INST\]|\[/INST\]'))
    + length(array_to_string(regexp_extract_all(t, '(\\*)(?:<s>|</s>|\[INST\]|\[/INST\])', 1), '')) + length(regexp_extract(t, '(\\*)$', 1)) as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
  sum(case when role = 'assistant' then length(t) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(chars))::bigint as formatted_chars
from e group by conv_id
"""
