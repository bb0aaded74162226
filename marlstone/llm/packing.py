"""Packing of documents into sequences of at most 4096 tokens, best fit decreasing.

A document's ids and an end id are cut into full windows, each a sequence of its own, and a rest. The rests are dealt at random to groups of about
``GROUP_TOKENS`` tokens, so many that they hold all rests and none grows with the corpus. In a group, rests go by decreasing length into the open window that they fill best:
a segment tree over the remaining capacities 0 to 4096, whose nodes count the open windows below them, finds the least capacity that is enough in 12 steps.

Where no rest fits, a window stays open. Windows that lack more than ``slack`` tokens are then topped up with tokens of the emptiest one, whose rests
are moved and, where needed, cut; what the last one holds is cut into sequences whose lengths are powers of two, as those aren't padded.
So a window is padded by ``slack`` tokens at most, whatever the lengths of documents are.

The ids are those of the tokenizer file. A worker remembers the ids of pre-tokens; texts with characters that the written-out pattern doesn't cover,
strings of added tokens or decomposed characters are encoded by the library whole (tests compare the two ways).

Defined results: a null or empty text is its end id alone; a null id stays null; equal rows are packed one by one; an empty table gives an empty result;
further columns are ignored. Reruns over one input layout give the same sequences; over another they may differ, the ids of documents don't.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import _L, _N, _S, _UNKNOWN, KNOWN, tokenizer

CAPACITY, SLACK, GROUP_TOKENS = 4096, 16, 1 << 19
#: Pre-tokens whose ids a Python worker keeps.
KEPT_PRETOKENS = 200_000
#: Characters of a text that are encoded at once, up to the next white space.
SLICE_CHARS = 1 << 18
#: The pre-tokenizer's published pattern, with its classes written out; it follows lower-casing.
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Characters that it doesn't cover, also once lower-cased, and the sigma, which Python lower-cases by its place.
_ODD = re.compile("[" + _UNKNOWN + "".join(c for c in map(chr, range(KNOWN)) if c == "Σ" or any(ord(x) >= KNOWN for x in c.lower())) + f"{chr(KNOWN)}-\U0010ffff]")
_GAP = re.compile(r"[ \t-\r]")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class Ids(dict):
    """Ids of texts as little-endian 32-bit numbers; pre-tokens are merged once by the library's model and remembered.

    When there are too many, the older half goes, but for those used since.
    """

    def __init__(self, tok) -> None:
        self.tok, self.old = tok, {}
        self.merged = tok.model.tokenize
        self.added = [t.content for t in tok.get_added_tokens_decoder().values()]

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            letters = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_LETTERS)
            ids = array("I", [t.id for t in self.merged(letters)]).tobytes()
        self[part] = ids
        return ids

    def fits(self, text: str) -> bool:
        """Whether the written-out rules hold."""
        if any(a in text for a in self.added):
            return False
        return text.isascii() or not _ODD.search(text) and unicodedata.is_normalized("NFC", text)

    def of(self, text: str) -> bytes:
        if not self.fits(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if 2 * len(self) > KEPT_PRETOKENS:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, PRETOKEN.findall(text.lower())))


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in slices of about ``size`` characters that begin with white space, which no token contains or crosses."""
    start = 0
    while len(text) - start > size:
        gap = _GAP.search(text, start + size)
        if not gap:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:]


@lru_cache(maxsize=4)
def ids_of(name: str) -> Ids:
    return Ids(tokenizer(name))


class OpenWindows:
    """Open windows by remaining capacity, and a segment tree that counts them."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, remaining: int, n: int) -> None:
        i = remaining + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, remaining: int, window: int) -> None:
        self.at[remaining].append(window)
        self._add(remaining, 1)

    def tightest(self, least: int) -> tuple[int, int] | None:
        """(remaining, window) with the least remaining capacity that is enough, which is taken out; the youngest of equals."""
        i = least + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        remaining = i - self.leaves
        self._add(remaining, -1)
        return remaining, self.at[remaining].pop()


Part = tuple[int, int, int]  # piece, first token, end


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows as lists of pieces, best fit decreasing; pieces of equal length in their order."""
    windows: list[list[int]] = []
    open_ = OpenWindows(capacity)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = open_.tightest(lengths[k])
        if found is None:
            windows.append([])
            found = capacity, len(windows) - 1
        remaining, w = found
        windows[w].append(k)
        if remaining > lengths[k]:
            open_.put(remaining - lengths[k], w)
    return windows


def _move(source: list[Part], target: list[Part], n: int) -> int:
    """Move up to ``n`` tokens from the end of ``source``; the last part is cut if it is longer than that. Returns how many were moved."""
    moved = 0
    while source and moved < n:
        k, a, b = source.pop()
        m = min(n - moved, b - a)
        if m < b - a:
            source.append((k, a, b - m))
        target.append((k, b - m, b))
        moved += m
    return moved


def pack(lengths: list[int], capacity: int = CAPACITY, slack: int = SLACK) -> list[list[Part]]:
    """Sequences as lists of parts of pieces, each token in one of them; none lacks more than ``slack`` tokens unless its length is a power of two."""
    done: list[list[Part]] = []
    loose: list[tuple[int, list[Part]]] = []
    for window in best_fit(lengths, capacity):
        used = sum(lengths[k] for k in window)
        parts = [(k, 0, lengths[k]) for k in window]
        if capacity - used <= slack or used & (used - 1) == 0:
            done.append(parts)
        else:
            loose.append((used, parts))
    loose.sort(key=lambda x: -x[0])
    first, last = 0, len(loose) - 1
    while first < last:
        used, parts = loose[first]
        while used < capacity and last > first:
            used += _move(loose[last][1], parts, capacity - used)
            last -= not loose[last][1]
        loose[first] = used, parts
        if used == capacity:
            done.append(parts)
            first += 1
    if first == last and loose[first][1]:
        parts = loose[first][1]
        used = sum(b - a for _, a, b in parts)
        while used:
            size = used if capacity - used <= slack else 1 << (used.bit_length() - 1)
            own: list[Part] = []
            used -= _move(parts, own, size)
            done.append(own)
    return done


PIECES = "doc_id {}, start long, length long, doc_tokens long, ids binary"


def cut_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids``: every document's full windows, then its rest if there is one.

    Ids are little-endian numbers of 32 bits, in rests of 16 bits if all ids fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = ids_of(tokenizer_file), np.array([end_id], "<u4").tobytes()
        rest = "<u2" if max(own.tok.get_vocab_size(), end_id) < 1 << 16 else "<u4"
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                at, out = [], []
                for k, text in enumerate(part.column("text")):
                    ids = b"".join([*map(own.of, slices(text.as_py() or "")), end])
                    n = len(ids) // 4
                    for a in range(0, n - n % capacity, capacity):
                        out.append((a, capacity, n, ids[4 * a : 4 * (a + capacity)]))
                    if n % capacity:
                        out.append((n - n % capacity, n % capacity, n, np.frombuffer(ids, "<u4")[n - n % capacity :].astype(rest).tobytes()))
                    at += [k] * (len(out) - len(at))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), *columns], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES.format(kind))


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, slack: int = SLACK, group_tokens: int = GROUP_TOKENS, **cut) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids, sequence_id, offset``: a row per piece of a document, its ids as little-endian 32-bit numbers.

    ``cut`` goes to ``cut_documents``. Sequence ids are unique, not dense. Ids of texts go through one shuffle.
    """
    pieces = materialize(cut_documents(docs, capacity=capacity, **cut).withColumn("at", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == capacity
    rests = pieces.where(~full)
    tokens = rests.agg(F.sum("length")).first()[0] or 0
    columns = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        starts, lengths, ids = rows["start"].tolist(), rows["length"].tolist(), rows["ids"].tolist()
        at, out = [], []
        for s, parts in enumerate(pack(lengths, capacity, slack)):
            offset = 0
            for k, a, b in parts:
                at.append(k)
                own = np.frombuffer(ids[k], "<u2" if len(ids[k]) == 2 * lengths[k] else "<u4")[a:b].astype("<u4").tobytes()
                out.append((starts[k] + a, b - a, own, int(rows["grp"].iloc[0]) << 33 | s << 1, offset))
                offset += b - a
        packed = pd.DataFrame(out, columns=["start", "length", "ids", "sequence_id", "offset"])
        return packed.assign(**{c: rows[c].iloc[at].array for c in ("doc_id", "doc_tokens")})

    kind = pieces.schema["doc_id"].dataType.simpleString()
    dealt = rests.withColumn("grp", F.pmod(F.xxhash64("at"), F.lit(max(1, -(-tokens // group_tokens)))))
    packed = dealt.groupBy("grp").applyInPandas(run, PIECES.format(kind) + ", sequence_id long, offset long")
    alone = pieces.where(full).select(*columns, (F.shiftleft("at", 1) + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.select(*alone.columns).unionByName(alone)


def op12_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
