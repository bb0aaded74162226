"""Token counts of whole texts with overlap resynchronisation for huge documents.

Every text is cut into chunks that overlap (a short one is a single chunk); each chunk is encoded by itself with offsets,
and neighbours are spliced at a boundary that both share and that is proven stable. When no such boundary lies in the
overlap, the overlap is doubled and tried again, in the worst case up to the end of the text. At most two chunks are held at a time,
so memory does not follow the longest document.

Why a shared boundary is proof. The byte-level pre-tokenizer scans from left to right and
keeps no state between its matches: what follows a boundary depends on the text after it
alone. Byte-pair merges never cross such a boundary. So if the scan of the left chunk, which
began at a true boundary, has a boundary at p, and the right chunk's scan has one at p too,
the right chunk's tokens from p on are those of the whole text. The left chunk's scan up to p
is that of the whole text if p is at least ``MARGIN`` characters from the left chunk's end,
since a match looks at most one character ahead and an added token is not longer than that; the
same distance from the right chunk's start keeps added tokens whole. Boundaries inside a
pre-token prove nothing and are not used.

Encoding a chunk means its pre-tokens' places and token counts. Below ``KNOWN`` the pre-tokenizer's pattern is written out, and a worker remembers
the counts of pre-tokens, each encoded once by the library; a chunk with other characters or an added token's string is
encoded by the library whole. The two give equal counts (tests compare them over every such character).

Defined results: null and empty texts have 0 bytes, 0 tokens and are not over the limit; a null
id stays null; equal rows give equal rows; an empty table gives an empty result. Input columns
other than the two named ones are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

CHUNK_CHARS, OVERLAP_CHARS, MARGIN = 2_048, 128, 32
#: Pre-tokens whose counts a Python worker keeps; then it starts afresh.
KEPT_PRETOKENS = 400_000


@lru_cache(maxsize=4)
def tokenizer(name: str, plain: bool = False):
    """The tokenizer file ``name`` of the public tokenizers, one per process, one thread.

    With ``plain``, strings of special tokens in a text are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
    own.no_truncation()
    own.no_padding()
    own.encode_special_tokens = plain
    return own


@lru_cache(maxsize=4)
def _added(tok) -> frozenset[int]:
    return frozenset(tok.get_added_tokens_decoder())


Boundaries = tuple[list[int], list[int]]


def chunk_boundaries(tok, text: str) -> Boundaries:
    """(start, index of its first token) of every pre-token of ``text``; then the end."""
    enc = tok.encode(text, add_special_tokens=False)
    starts, firsts, last = [], [], None
    special = _added(tok)
    # A pre-token is the first after an added token or where the word number changes.
    for k, (i, word, (a, _)) in enumerate(zip(enc.ids, enc.word_ids, enc.offsets, strict=True)):
        if i in special or last is None or word != last:
            starts.append(a)
            firsts.append(k)
        last = None if i in special else word
    return [*starts, len(text)], [*firsts, len(enc.ids)]


def splice(bounds: Boundaries, start: int, taken: int, other: Boundaries, nxt: int, low: int, high: int) -> tuple[int, int] | None:
    """(token of the left chunk, token of the right one) at their last shared boundary from ``low`` to ``high``."""
    (left, firsts), (right, r_firsts) = bounds, other
    for j in range(min(bisect_right(right, high - nxt), len(right) - 1) - 1, bisect_left(right, low - nxt) - 1, -1):
        i = bisect_left(left, nxt + right[j] - start)
        if i < len(left) - 1 and left[i] == nxt + right[j] - start and firsts[i] >= taken:
            return firsts[i], r_firsts[j]
    return None


def count_by_chunks(text: str, encode: Callable[[str], Boundaries], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = MARGIN) -> tuple[int, int]:
    """Number of tokens of ``text``, and of splices between its chunks; at most two chunks are held at a time."""
    n, total, splices = len(text), 0, 0
    start, end = 0, min(chunk + overlap, n)  # the left chunk
    left = encode(text[:end])
    taken = 0  # tokens of the left chunk that belong to what was spliced before it
    while end < n:
        width, nxt = overlap, max(start + 1, end - overlap)
        while True:
            right_end = min(end + chunk, n)  # beyond the left chunk, however far that was widened
            right = encode(text[nxt:right_end])
            at = splice(left, start, taken, right, nxt, nxt + margin, end - margin)
            if at is not None:
                total, taken, splices = total + at[0] - taken, at[1], splices + 1
                start, end, left = nxt, right_end, right
                break
            width *= 2  # widen the overlap: the left chunk is encoded again, further on
            end = min(end + width, n)
            left = encode(text[start:end])
            if end >= n:  # the left chunk now reaches the end and needs no partner
                return total + left[1][-1] - taken, splices
    return total + left[1][-1] - taken, splices


#: Characters below it are written out in the pattern.
KNOWN = 0x3000


def _classes() -> tuple[str, str, str, str]:
    """Letters, numbers, white space and what is not assigned (the library may know a later Unicode) below KNOWN, for a character class."""
    at = [chr(c) for c in range(KNOWN)]
    pick = lambda kind: "".join(re.escape(c) for c in at if unicodedata.category(c)[0] == kind)
    unknown = "".join(c for c in at if unicodedata.category(c) == "Cn")
    return pick("L"), pick("N"), "\\t-\\r \\x85" + "".join(c for c in at if unicodedata.category(c)[0] == "Z" and c != " "), unknown


_L, _N, _S, _UNKNOWN = _classes()
#: The pre-tokenizer's published pattern, with its classes written out.
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile(f"[{_UNKNOWN}{chr(KNOWN)}-\U0010ffff]")


class Encoder:
    """Boundaries and token counts of chunks; pre-tokens are encoded once by the library and remembered."""

    def __init__(self, tok) -> None:
        self.tok, self.kept = tok, {}
        self.added = [t.content for t in tok.get_added_tokens_decoder().values()]

    def fits(self, text: str) -> bool:
        return not _OTHER.search(text) and not any(a in text for a in self.added)

    def learn(self, parts: Iterable[str]) -> None:
        """Remember the counts of these pre-tokens."""
        if len(self.kept) > KEPT_PRETOKENS:
            self.kept.clear()
        new = list(set(parts).difference(self.kept))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            self.kept.update(zip(some, map(len, self.tok.encode_batch_fast(some, add_special_tokens=False)), strict=True))

    def boundaries(self, text: str) -> Boundaries:
        if not self.fits(text):
            return chunk_boundaries(self.tok, text)
        parts = PRETOKEN.findall(text)
        try:
            counts = list(map(self.kept.__getitem__, parts))
        except KeyError:
            self.learn(parts)
            counts = map(self.kept.__getitem__, parts)
        return [0, *accumulate(map(len, parts))], [0, *accumulate(counts)]


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    return Encoder(tokenizer(name))


def count_texts(texts: list[str], name: str, chunk_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """(tokens, splices) in the order of ``texts``."""
    own = encoder(name)
    return [count_by_chunks(t, own.boundaries, chunk_chars, overlap_chars) if t else (0, 0) for t in texts]


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str = "byte_bpe_50k.json",
    limit: int = 1024,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, n_splices, over_limit``, one row per row of ``docs``; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), 256):
                part = rows.iloc[i : i + 256]
                texts = [t or "" for t in part["text"]]
                n_tokens, n_splices = zip(*count_texts(texts, tokenizer_file, chunk_chars, overlap_chars), strict=True)
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n_tokens, "n_splices": n_splices})

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, n_splices long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
