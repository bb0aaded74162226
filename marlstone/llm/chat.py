r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text, turn after turn in the order of ``turn``::

    <turn>ROLE\nTEXT</turn>\n

In roles and texts a backslash becomes ``\\``, ``<`` becomes ``\l`` and, in roles, a line end
becomes ``\n`` in two characters. So no control string can come from a text, and a raw ``<``
always begins one; ``parse`` reads roles and texts back exactly.

The text is encoded once, with offsets. The spans of the assistants' texts, sorted, are intersected
with the tokens' spans by binary search: the tokens of a span are those that end after its
start and start before its end. A token on an edge counts as masked, with its characters inside the span alone.

Defined results: a null text or role is empty; turns with equal or null numbers come in
the order (turn, role, text), nulls first; equal rows are turns of their own; a null conv_id is a conversation; an
empty table gives an empty result (the added conversation apart). Other columns are ignored. A conversation is one
sequence, hashed and tokenised as a whole, and so the unit of work; conversations are spread by their id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import tokenizer

OPEN, CLOSE = "<turn>", "</turn>\n"
_TURN = re.compile(r"<turn>([^<\n]*)\n([^<]*)</turn>\n")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLAIN = {"\\": "\\", "l": "<", "n": "\n"}


def escape(text: str, line: bool = False) -> str:
    """``text`` without control strings; with ``line``, in one line."""
    text = text.replace("\\", "\\\\").replace("<", "\\l")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def render(turns: Sequence[tuple[str, str]], masked_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the masked role's texts in it, sorted."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}\n", escape(text)
        if role == masked_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; other texts are an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def mask(offsets: np.ndarray, spans: Sequence[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Whether each token (rows of start, end, sorted) is masked; the masked pieces of text, merged, in order."""
    flags = np.zeros(len(offsets), bool)
    kept: list[tuple[int, int]] = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        flags[first:last] = True
        lo, hi = np.maximum(starts[first:last], a), np.minimum(ends[first:last], b)
        if len(lo):
            # tokens lie end to end; pieces of one character share its span
            seams = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1])
            edges = np.concatenate([[0], seams + 1, [len(lo)]])
            kept += [(int(lo[i]), int(hi[i:j].max())) for i, j in zip(edges[:-1], edges[1:], strict=True) if hi[i:j].max() > lo[i]]
    return flags, kept


def offsets_of(tok, text: str) -> tuple[list[int], np.ndarray]:
    enc = tok.encode(text, add_special_tokens=False)
    return enc.ids, np.array(enc.offsets, np.int64).reshape(-1, 2)


def _sha(*parts: str) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode())
    return h.hexdigest()


FORMATTED = "conv_id long, formatted string, input_ids array<int>, loss_mask array<byte>, loss_spans array<struct<start: int, end: int>>"


def _format_partition(tokenizer_file: str, masked_role: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(tokenizer_file, plain=True)
        for rows in batches:
            out = []
            for conv, turns in zip(rows["conv_id"], rows["turns"], strict=True):
                text, spans = render([(t["role"] or "", t["text"] or "") for t in turns], masked_role)
                ids, offsets = offsets_of(tok, text)
                flags, kept = mask(offsets, spans)
                out.append((conv, text, ids, flags.astype(np.int8).tolist(), kept))
            yield pd.DataFrame(out, columns=["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"])

    return run


def gather(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of every conversation in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, *, tokenizer_file: str = "byte_bpe_50k.json", masked_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, token ids, token mask and the masked spans of the text."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return gather(rows).mapInPandas(_format_partition(tokenizer_file, masked_role), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the mask, from the formatted output alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for conv, text, spans in zip(rows["conv_id"], rows["formatted"], rows["loss_spans"], strict=True):
                turns = parse(text)
                loss = unescape("".join(text[s["start"] : s["end"]] for s in spans))
                out.append((conv, len(turns), _sha(*(x for r, t in turns for x in (r, "\n", t, "\n"))), len(loss), _sha(loss), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts look like control strings.
ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.unionByName(own)))


#: ``op5_chat_format``: the template adds 6 + 1 + 8 characters a turn, and one for each character it escapes.
OP5_SQL = r"""
  WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS body FROM (
      SELECT conv_id, turn, role, "text" FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
  sized AS (SELECT *, 15 + 3 * length(role) - length(replace(role, '\', '')) - length(replace(replace(role, '<', ''), chr(10), ''))
      + 3 * length(body) - length(replace(body, '\', '')) - length(replace(body, '<', '')) AS n FROM turns)
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
    CAST(coalesce(sum(length(body)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id"""
