"""Text functions on columns that agree with Python's string methods and ``re``."""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` and ``str.split`` see it.
_WS = r"[\s\x1c-\x1f]"

# Patterns and marker strings that decide results.
UNINFORMATIVE = r".*[nN]o.*information.*|.*[nN]o.*facts.*|.*[nN]o.*mention.*|.*[nN]o.*tweets.*|.*do not contain.*"
DIRECTION = r"stock\s*return\s*:\s*[-+]?\d+(?:\.\d+)?\s*%?\s*\(\s*(up|down)\s*\)"
ANSWER_MARK = "Price Movement: "
EXAMPLES_MARK, EXAMPLES_END = "Here are some examples:", "(END OF EXAMPLES)"
FAILURE_MARK = "You have attempted to tackle the following task before and failed."
FACTS_MARK = "\n\nFacts:"
POSITIVE, NEGATIVE, UNKNOWN = "Positive", "Negative", "Unknown"


def strip(text: Column) -> Column:
    """Without white space at both ends (``trim`` takes spaces alone)."""
    return F.regexp_replace(text, f"(?U)\\A{_WS}+|{_WS}+\\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){_WS}+\\z", "")


def first_token(text: Column) -> Column:
    """The first token between white space; null where there is none."""
    token = F.regexp_extract(text, "(?U)\\A" + _WS + r"*([^\s\x1c-\x1f]+)", 1)
    return F.when(token != "", token)


def after_last(text: Column, mark: str) -> Column:
    """What follows the last ``mark``; the whole text if there is none."""
    return F.substring_index(text, mark, -1)


def before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def informative(summary: Column, scan_all_lines: bool = False) -> Column:
    """Whether a summary states something; null and empty ones do not.

    Only the first line is looked at, unless ``scan_all_lines``. A line ends at a line feed alone. The
    same texts match as for ``UNINFORMATIVE`` at the start of the text, in time linear in their length.
    """
    whole = F.coalesce(summary, F.lit(""))
    line = whole if scan_all_lines else before_first(whole, "\n")
    lower, upper = F.locate("no", line), F.locate("No", line)
    first = F.when(lower == 0, upper).when(upper == 0, lower).otherwise(F.least(lower, upper))
    rest = F.substring(line, first + 2, F.length(line))  # the first "no" leaves the most text after it
    hit = line.contains("do not contain")
    for subject in ("information", "facts", "mention", "tweets"):
        hit = hit | ((first > 0) & rest.contains(subject))
    return ~hit & (whole != "")


def direction(response: Column) -> Column:
    """Positive, Negative or Unknown, from the first stated return with a direction."""
    bare = F.replace(F.lower(strip(response)), F.lit("**"), F.lit(""))
    found = F.regexp_extract(bare, f"(?U){DIRECTION}", 1)
    return F.when(found == "up", POSITIVE).when(found == "down", NEGATIVE).otherwise(UNKNOWN)


def prediction(scratchpad: Column) -> Column:
    """The first token of the last answer; null if it is blank."""
    return first_token(after_last(scratchpad, ANSWER_MARK))


def same(a: Column, b: Column) -> Column:
    """Equality without regard to case; a null is equal to nothing."""
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """``str.format`` with columns: a null value makes the result null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def bullets(items: Column, header: str) -> Column:
    """``header``, then a bullet for each item; empty for no items."""
    lines = F.array_join(F.transform(items, strip), "\n- ")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{header}Reflections:\n- "), lines)).otherwise("")


def remove_fewshot(prompt: Column) -> Column:
    """The prompt without its examples; null where the end mark is missing."""
    tail = F.try_element_at(F.split(prompt, re.escape(EXAMPLES_END)), F.lit(2))
    return F.concat(strip(before_first(prompt, EXAMPLES_MARK)), F.lit("\n\n"), strip(tail))


def remove_reflections(prompt: Column, keep_colon: bool = False) -> Column:
    """The prompt without reflections. The colon after "Facts" is lost unless ``keep_colon``."""
    glue = "\n\nFacts:\n" if keep_colon else "\n\nFacts"
    return F.concat(strip(before_first(prompt, FAILURE_MARK)), F.lit(glue), strip(after_last(prompt, FACTS_MARK)))


def python_list(texts: Column) -> Column:
    """An array of strings as Python writes a list of them: quotes, escapes and all; null elements are None."""

    def write(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in lists:
            yield pd.Series([None if x is None else repr(list(x)) for x in series], dtype=object)

    write.__annotations__ = {"lists": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(write, "string")(texts)


def list_parts(texts: Iterable[str | None]) -> Iterator[str]:
    """What ``python_list`` gives for ``texts``, piece by piece."""
    yield "["
    for i, t in enumerate(texts):
        yield f", {t!r}" if i else repr(t)
    yield "]"


def pack(x: str | None) -> bytes | None:
    """A text compressed by itself, after its length in bytes."""
    if x is None:
        return None
    raw = x.encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def packed_size(x: bytes) -> int:
    """Bytes of the text in it."""
    return int.from_bytes(x[:8], "little")


def unpack_bytes(x: bytes) -> bytes:
    return pa.Codec("zstd").decompress(x[8:], packed_size(x), asbytes=True)


def unpack(x: bytes | None) -> str | None:
    return None if x is None else unpack_bytes(x).decode()


def tighten(x: str | None) -> bytes | None:
    """A text compressed by itself as far as it gets smaller, for one that is packed once and moved many times: slower than ``pack``, a tenth smaller."""
    if x is None:
        return None
    raw = x.encode()
    small = bz2.compress(raw)
    return b"b" + small if len(small) < len(raw) else b"r" + raw


def loosen(x: bytes | None) -> str | None:
    return None if x is None else (bz2.decompress(x[1:]) if x[:1] == b"b" else x[1:]).decode()


def tight(texts: Column) -> Column:
    """``tighten`` of a column."""

    def write(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series([tighten(x) for x in s], dtype=object)

    write.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(write, "binary")(texts)


def packed(texts: Column) -> Column:
    """Texts compressed one by one, for a shuffle: its own codec takes prose to two thirds, this one to less than half."""

    def write(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series([pack(x) for x in s], dtype=object)

    write.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(write, "binary")(texts)


def loose(values: Column) -> Column:
    """``loosen`` of a column."""

    def read(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series([loosen(x) for x in s], dtype=object)

    read.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(read, "string")(values)
