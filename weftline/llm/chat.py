"""Chat formatting by incremental black-box rendering.

A template is a black box: a function from a list of ``(role, text)`` to a string.  To find where
turn k stands in the output, the first k turns are rendered, and the first k with a probe in place
of the last text; what precedes and follows the probe frames the text, and what the output of
k turns adds to that of k-1 is the turn's span.  Where the output of k-1 turns is not a prefix
of that of k, the template rewrites history: that is reported, and spans then come from
probing each turn inside the whole output.  Every prefix is rendered whole, so a black box costs
the square of a conversation's turns and holds a whole conversation.  The query's template is such a black box.

A template that is known never to rewrite history can bring a ``step``, which renders one turn
from a state that stands for all turns before: the next prefix is then the last one and what the
step adds, probed in the same way, so that work is linear in the turns and memory is that of a
turn.  The first prefixes (``COMPARED``) of each conversation are rendered both ways, and an error
is raised where the two differ.  A template may also bring the inverses of its escapes and of how it
writes roles; where it does, texts and roles are read back from the output, else texts are taken
as they stand there and roles from the turn that stands in the span.

Edge cases: a null text or role is empty; turns are ordered by turn (null first), role and
text, repeated ones are kept; a text of any length is rendered whole; a text that the template
drops is empty in the output, of one that it writes several times in a turn the first is read; rows without conv_id are one conversation of their own, with a null
conv_id; a table without rows gives only the added conversation; other columns are not read.  The
turns of a conversation stream through one task in order, as its digests are sequential.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

#: Prefixes that a template with steps renders both ways.
COMPARED = 4
#: The plain template remembers how it wrote so many turns, of texts up to so many characters.
REMEMBERED, SHORT = 8192, 4096

CONTROL = re.compile(r"\\|#{3,}|</turn>")


def escape(text: str) -> str:
    """Put backslashes into each control string, so that none is left whole."""
    if not ("\\" in text or "###" in text or "</turn>" in text):
        return text
    return CONTROL.sub(lambda m: "\\</turn\\>" if m[0][0] == "<" else "".join("\\" + c for c in m[0]), text)


def unescape(text: str) -> str:
    """What was escaped."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _named(role: str) -> str:
    return escape(role).replace(":", "\\:")


def plain_template(turns: list[Turn]) -> str:
    """``### role:`` and a line break, the text, and ``</turn>``, for each turn."""
    return "".join([(_remembered if len(text) <= SHORT else _written)(role, text) for role, text in turns])


def _written(role: str, text: str) -> str:
    return f"### {_named(role)}:\n{escape(text)}\n</turn>\n"


_remembered = functools.lru_cache(REMEMBERED)(_written)


def role_of(head: str) -> str:
    """The role that the plain template wrote before a text."""
    return unescape(re.match(r"### ((?:\\.|[^\\:])*):\n", head, re.S)[1])


@dataclass(frozen=True)
class Template:
    """A black box, and what may be known of it.

    ``step(state, role, text)`` gives ``(state, what the turn adds)``, without changing the state it
    was given, which is None at first; ``role`` reads a role from what stands before the text in a
    turn's span; ``unescape`` is the inverse of what is done to texts.
    """

    render: Render
    step: Callable[[object, str, str], tuple[object, str]] | None = None
    role: Callable[[str], str] | None = None
    unescape: Callable[[str], str] = str


#: Without steps: every prefix is rendered whole.
PLAIN = Template(plain_template, role=role_of, unescape=unescape)


@dataclass
class Span:
    """Where a turn stands in the output: the whole turn, and its text."""

    start: int
    end: int
    text_start: int
    text_end: int


@dataclass
class Rendered:
    output: str
    spans: list[Span]
    rewrites_history: bool


def _probe(used: str) -> str:
    """A sign that isn't used, three times: a control one if any is left, as it doesn't make narrow outputs wide."""
    return next(chr(c) * 3 for c in (*range(0x86, 0xA0), *range(0xE000, 0xF8FF)) if chr(c) not in used)


def _added(prefix: str, output: str, probed: str, probe: str) -> Span | None:
    """The span of a turn that ends the output and follows the prefix; None where what precedes the probe isn't in it."""
    start, kept = len(prefix), probed.startswith(prefix)
    at = probed.find(probe, start if kept else 0)
    if at < 0:
        return Span(start, len(output), len(output), len(output))
    if not kept or output[start:at] != probed[start:at]:
        return None
    return Span(start, len(output), at, at + _size(output, probed, probe, at))


def _size(output: str, probed: str, probe: str, at: int) -> int:
    """Characters of the text that the probe stands for, which the template may write several times, first at ``at``."""
    return (len(output) - len(probed)) // probed.count(probe, at) + len(probe)


def locate(template: Render, turns: list[Turn]) -> Rendered:
    """Render a conversation and find the spans of its turns."""
    probe, prefix, spans = _probe("".join(r + t for r, t in turns)), _opening(template), []
    for k, (role, text) in enumerate(turns):
        output = template(turns[: k + 1])
        span = _added(prefix, output, template(turns[:k] + [(role, probe)]), probe) if output.startswith(prefix) else None
        if span is None:
            break
        spans.append(span)
        prefix = output
    else:
        return Rendered(prefix, spans, False)
    whole, spans = template(turns), []
    for k, (role, text) in enumerate(turns):
        probed = template(turns[:k] + [(role, probe)] + turns[k + 1 :])
        at = probed.find(probe)
        end = at + _size(whole, probed, probe, at) if at >= 0 else 0
        spans.append(Span(max(at, 0), end, max(at, 0), end))
    return Rendered(whole, spans, True)


def _opening(template: Render) -> str:
    """What the template writes without any turn; nothing, if it can't."""
    try:
        return template([])
    except (IndexError, KeyError, ValueError):
        return ""


class _Reader:
    """Digests of one conversation, fed turn by turn."""

    def __init__(self, template: Template):
        self.template = template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.formatted = 0
        self.rewrites, self.state = False, None
        self.held: list[Turn] = []  # the first turns, or all of them for a black box
        self.shown = ""

    def feed(self, role: str, text: str) -> None:
        if self.template.step is None:
            self.held.append((role, text))
            return
        state, output = self.template.step(self.state, role, text)
        probe = _probe(output)
        span = _added("", output, self.template.step(self.state, role, probe)[1], probe)
        if self.n < COMPARED:
            self.held.append((role, text))
            self.shown += output
            if span is None or self.template.render(self.held) != self.shown:
                raise ValueError("the template's steps are not what it renders")
        self.state = state
        self.formatted += len(output)
        self._read(role, output, span)

    def end(self) -> None:
        if self.template.step is None:
            got = locate(self.template.render, self.held)
            self.rewrites, self.formatted = got.rewrites_history, len(got.output)
            for (role, _), s in zip(self.held, got.spans):
                self._read(role, got.output, s)

    def _read(self, role: str, output: str, span: Span) -> None:
        text = self.template.unescape(output[span.text_start : span.text_end])
        if self.template.role is not None:
            role = self.template.role(output[span.start : span.text_start])
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            self.loss.update(text.encode())
            self.loss_chars += len(text)


def digest(conversations: DataFrame, template: Template = PLAIN) -> DataFrame:
    """Counts and digests of every conversation, read back from its formatted output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, rows = None, None, []

        def end() -> None:
            reader.end()
            rows.append((now, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted, reader.rewrites))

        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for i, conv in enumerate(ids):
                if reader is None or conv != now:
                    if reader is not None:
                        end()
                    now, reader = conv, _Reader(template)
                reader.feed(roles[i] or "", texts[i] or "")
            if rows:
                yield packed(rows)
                rows.clear()
        if reader is not None:
            end()
        if rows:
            yield packed(rows)

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold the template's own control strings."""
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digest(rows.unionByName(own)).drop("rewrites_history")


def _sql_escaped(x: str) -> str:
    """Length of an escaped text."""
    signs = f"len(array_to_string(regexp_extract_all({x}, '#{{3,}}'), ''))"
    return f"(length({x}) + len(regexp_extract_all({x}, '\\\\')) + {signs} + 2 * len(regexp_extract_all({x}, '</turn>')))"


QUERIES = {"op4_chat": op4_chat}
ORACLE_SQL = {
    "op4_chat": f"""
WITH t AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_sql_escaped('role')} + len(regexp_extract_all(role, ':')) + {_sql_escaped('text')} + 15) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
