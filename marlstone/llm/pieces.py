r"""Sampled SentencePiece segmentations by forward filtering, backward sampling.

A text becomes a lattice: an edge for every piece of the vocabulary that matches at a place, byte
pieces for characters that no piece covers. The forward pass sums, for every place, the weights of all
ways to reach it; the backward pass draws, from the end of the text, the last piece with its share of that
sum, and so on. Every segmentation is drawn with a probability in proportion to the product of its pieces'
probabilities to the power ``alpha``.

Between two characters that no piece of the vocabulary has side by side the lattice falls apart, exactly: before the
space sign that follows a word, mostly before punctuation, around line ends and other characters that only byte
pieces cover. The forward pass of such a unit depends on its characters alone; a Python worker keeps it for units seen
before, and takes all new units of some rows together in numpy, place by place. The backward pass walks all
units of some rows at once. Its random numbers are a hash of the row's key, the unit's place in the text and the
step: equal keys and texts give equal segmentations, wherever they run.

The vocabulary's scores are log-probabilities in a unigram model. A BPE model has merge ranks instead; its
pieces get probabilities by Zipf's law, 1 / (rank + 2).

Text is taken as it is, with no normalisation, so decoding is lossless: a space sign in front (as
the library's encoder adds), spaces as space signs, a literal U+2581 in bytes. The library's own decoder
reads the ids back too.

Defined results: null and empty texts have no pieces and decode to an empty text; a null key is a key of its own; equal rows get
equal pieces; an empty table gives an empty result. Input columns other than the named ones are carried through.
Texts are read whole; a very long one is walked in slices of ``SLICE`` units.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

SPACE = "▁"
#: Units of one backward pass; units, and edges, that a worker keeps.
SLICE, KEPT_UNITS, KEPT_EDGES = 1 << 17, 250_000, 5_000_000
MODEL_FILE = "piece_bpe_32k.model"


@lru_cache(maxsize=2)
def processor(name: str):
    """The library's processor for a model file of the public tokenizers."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name) if "/" not in name else name)


class Vocabulary:
    """Pieces, their weights and bytes."""

    def __init__(self, name: str, alpha: float) -> None:
        sp = processor(name)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if i not in special and not sp.is_byte(i)]
        scores = {i: sp.get_score(i) for i in plain}
        if all(s == int(s) for s in scores.values()):  # merge ranks
            log = {i: -np.log(r + 2.0) for r, i in enumerate(sorted(plain, key=lambda i: (-scores[i], i)))}
        else:
            log = scores
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.weight = {i: float(np.exp(alpha * log[i])) for i in plain}
        self.byte_weight = float(np.exp(alpha * (min(log.values()) - 1)))
        self.width = max(map(len, self.ids))
        self.raw = [b""] * n
        for p, i in self.ids.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.size = n
        self._tables()

    def _tables(self) -> None:
        """The trie of the pieces as sorted keys (node, character), and where a text falls apart."""
        letters = sorted({c for p in self.ids for c in p})
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letters = len(letters)
        node = {h: i for i, h in enumerate(sorted({p[:k] for p in self.ids for k in range(len(p) + 1)}))}
        self.ends = np.full(len(node), -1, np.int64)
        for p, i in self.ids.items():
            self.ends[node[p]] = i
        steps = sorted((node[h[:-1]] * self.letters + int(self.letter[ord(h[-1])]), i) for h, i in node.items() if h)
        self.keys, self.next = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        #: Characters that are pieces by themselves; the text's space is one if the space sign is.
        self.alone = {" " if c == SPACE else c for c in letters if c in self.ids}
        self.shares = np.zeros(self.size)
        self.shares[list(self.weight)] = list(self.weight.values())
        #: Units of more characters could leave the range of a double.
        self.longest = max(1, int(-250 / np.log10(min(self.weight.values()))))
        # Rows and columns of the pairs: characters below U+0250, then the space sign, other letters, the rest.
        self.kind = np.full(0x110000, 0x252, np.int16)
        self.kind[self.letter >= 0] = 0x251
        low = np.arange(0x250)
        self.kind[low] = np.where(self.letter[low] >= 0, low, 0x252)
        self.kind[ord(SPACE)] = 0x252  # in a text, a literal one
        self.kind[ord(" ")] = 0x250
        self.joined = np.zeros((0x253, 0x253), bool)
        self.joined[0x251, :0x252] = self.joined[:0x252, 0x251] = True
        at = lambda c: 0x250 if c == SPACE else int(self.kind[ord(c)])
        for p in self.ids:
            for x, y in zip(p, p[1:], strict=False):
                self.joined[at(x), at(y)] = True

    def units(self, text: str) -> list[str]:
        """``text`` cut wherever no piece can cross."""
        kind = self.kind[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        cuts = (np.flatnonzero(~self.joined[kind[:-1], kind[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def covers(self, unit: str) -> bool:
        """Whether pieces cover the unit, which is else one character in bytes."""
        return len(unit) > 1 or self.kind[ord(unit)] != 0x252


def forward(unit: str, v: Vocabulary) -> list[list[tuple[float, int, str | int]]]:
    """For every place 1..n of ``unit``: (share of the sum, start, piece id or character) of the edges that end there, likeliest first."""
    n = len(unit)
    ends: list[list] = [[] for _ in range(n + 1)]
    total = [0.0] * (n + 1)
    total[0] = 1.0
    ids, weight, width = v.ids, v.weight, v.width
    for s in range(n):
        here = total[s]
        if s and here < 1e-120:  # only ratios matter; what lies further back is done with
            for p in range(s, min(n, s + width) + 1):
                total[p] *= 1e120
                ends[p] = [(w * 1e120, a, x) for w, a, x in ends[p]]
            here = total[s]
        for e in range(s + 1, min(n, s + width) + 1):
            if (i := ids.get(unit[s:e])) is not None:
                w = here * weight[i]
                total[e] += w
                ends[e].append((w, s, i))
        if unit[s] not in ids:  # a letter that stands in longer pieces alone
            w = here * v.byte_weight ** len(unit[s].encode())
            total[s + 1] += w
            ends[s + 1].append((w, s, unit[s]))
    return [[(w / total[p], s, x) for w, s, x in sorted(ends[p], key=lambda e: -e[0])] for p in range(1, n + 1)]


class Lattices:
    """Forward passes of units, end to end in arrays.

    Node k's edges begin at ``first[k]``; ``upto`` has the running shares, ``back`` the node an edge
    comes from (-1: the unit's start), ``code`` its piece or, from the vocabulary's size on, a character in bytes.
    """

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.chars: dict[str, int] = {}
        self.char_ids: list[list[int]] = []
        self.clear()

    def clear(self, edges: int = 0) -> None:
        room = max(KEPT_EDGES, 2 * edges)
        self.end: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.first = np.zeros(room, np.int32)
        self.upto, self.back, self.code = np.zeros(room), np.zeros(room, np.int32), np.zeros(room, np.int32)

    def _code(self, x: int | str) -> int:
        if not isinstance(x, str):
            return x
        raw = x.encode()
        if len(raw) == 1:
            return self.v.byte[raw[0]]
        if x not in self.chars:
            self.chars[x] = len(self.char_ids)
            self.char_ids.append([self.v.byte[b] for b in raw])
        return self.v.size + self.chars[x]

    def _put(self, firsts: np.ndarray, upto: np.ndarray, back: np.ndarray, code: np.ndarray) -> int:
        """Append nodes (their first edges) and edges, counted from 0; the number of the first node."""
        n, e = len(firsts), len(upto)
        if self.edges + e > len(self.upto):
            raise MemoryError
        base = self.nodes
        self.first[base : base + n] = firsts + self.edges
        part = slice(self.edges, self.edges + e)
        self.upto[part], self.code[part] = upto, code
        self.back[part] = np.where(back >= 0, back + base, -1)
        self.nodes, self.edges = base + n, self.edges + e
        return base

    def _add_one(self, unit: str) -> None:
        """A unit by the plain forward pass."""
        edges = forward(unit.replace(" ", SPACE), self.v) if self.v.covers(unit) else [[(1.0, 0, unit)]]
        firsts = np.cumsum([0, *map(len, edges)])
        flat = [x for node in edges for x in node]
        upto = np.concatenate([np.cumsum([w for w, _, _ in node]) for node in edges])
        upto[firsts[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        back, code = np.array([s - 1 for _, s, _ in flat]), np.array([self._code(x) for _, _, x in flat])
        self.end[unit] = self._put(firsts[:-1], upto, back, code) + len(edges) - 1

    def _add_many(self, units: list[str]) -> None:
        """Short units whose letters are all pieces, together. A place is a node: that of the character before it."""
        v = self.v
        lens = np.fromiter(map(len, units), np.int64, len(units))
        stops = np.cumsum(lens)
        letter = v.letter[np.frombuffer("".join(units).replace(" ", SPACE).encode("utf-32-le"), "<u4")].astype(np.int64)
        begin, stop = np.repeat(stops - lens, lens), np.repeat(stops, lens)
        at = np.arange(len(letter))
        trie = np.zeros(len(at), np.int64)
        starts, ends, codes = [], [], []
        for k in range(v.width):
            key = trie * v.letters + letter[at + k]
            i = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            on = v.keys[i] == key
            at, trie = at[on], v.next[i[on]]
            hit = v.ends[trie] >= 0
            starts.append(at[hit])
            ends.append(at[hit] + k)
            codes.append(v.ends[trie[hit]])
            more = at + k + 1 < stop[at]
            at, trie = at[more], trie[more]
            if not len(at):
                break
        start, end, code = map(np.concatenate, (starts, ends, codes))
        order = np.argsort(end - begin[end], kind="stable")
        start, end, code = start[order], end[order], code[order]
        inner = start > begin[start]
        weight = v.shares[code]
        total = np.zeros(len(letter))
        rounds = np.concatenate([[0], np.cumsum(np.bincount(end - begin[end]))])
        for a, b in zip(rounds[:-1].tolist(), rounds[1:].tolist(), strict=True):
            weight[a:b] *= np.where(inner[a:b], total[start[a:b] - 1], 1.0)
            np.add.at(total, end[a:b], weight[a:b])
        order = np.lexsort((-weight, end))
        start, end, code, inner = start[order], end[order], code[order], inner[order]
        run = np.cumsum(weight[order] / total[end])
        firsts = np.searchsorted(end, np.arange(len(letter)))
        upto = run - np.concatenate([[0.0], run])[firsts][end]
        upto[np.append(firsts[1:], len(end)) - 1] = 2.0
        base = self._put(firsts, upto, np.where(inner, start - 1, -1), code)
        self.end.update(zip(units, (base + stops - 1).tolist(), strict=True))

    def find(self, units: list[str]) -> np.ndarray:
        """The last node of every unit; new ones are added."""
        if len(self.end) > KEPT_UNITS:
            self.clear()
        try:
            return self._find(units)
        except MemoryError:  # no room beside what was kept
            self.clear(sum(map(len, set(units))) * self.v.width)
            return self._find(units)

    def _find(self, units: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(x for x in units if x not in self.end))
        many = []
        for x in new:
            if len(x) <= self.v.longest and self.v.covers(x) and self.v.alone.issuperset(x):
                many.append(x)
            else:
                self._add_one(x)
        for i in range(0, len(many), 20_000):
            self._add_many(many[i : i + 20_000])
        return np.fromiter(map(self.end.__getitem__, units), np.int64, len(units))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _walk(lat: Lattices, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling from every node: the codes of all units in order, and how many each has."""
    first, upto, back, code = lat.first, lat.upto, lat.back, lat.code
    who, at, step = np.arange(len(nodes)), nodes, 0
    taken, length = [], np.zeros(len(nodes), np.int64)
    while len(who):
        u = (_mix(keys[who] + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) * 2.0**-53
        edge = first[at].astype(np.int64)
        late = np.flatnonzero(u >= upto[edge])
        while len(late):
            edge[late] += 1
            late = late[u[late] >= upto[edge[late]]]
        taken.append((who, code[edge]))
        length[who] += 1
        at = back[edge]
        on = at >= 0
        who, at, step = who[on], at[on], step + 1
    stop = np.cumsum(length)
    codes = np.empty(int(stop[-1]) if len(stop) else 0, np.int64)
    for k, (who, c) in enumerate(taken):
        codes[stop[who] - 1 - k] = c
    return codes, length


class Sampler:
    """Samples segmentations of texts."""

    def __init__(self, name: str = MODEL_FILE, alpha: float = 1.0, seed: int = 42) -> None:
        self.v, self.seed = Vocabulary(name, alpha), seed
        self.lat = Lattices(self.v)

    def key(self, row: object) -> int:
        return xxhash.xxh64_intdigest("~" if row is None else str(row), self.seed)

    def _expand(self, codes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte sequences in place of codes for characters; parts: codes per text."""
        size = self.v.size
        if not len(codes) or codes.max() < size:
            return codes.astype(np.int32), parts
        lens = np.ones(len(codes), np.int64)
        high = np.flatnonzero(codes >= size)
        lens[high] = [len(self.lat.char_ids[c - size]) for c in codes[high].tolist()]
        out = np.repeat(codes, lens)
        starts = np.cumsum(lens) - lens
        for h in high.tolist():
            out[starts[h] : starts[h] + lens[h]] = self.lat.char_ids[codes[h] - size]
        owner = np.repeat(np.arange(len(parts)), parts)
        return out.astype(np.int32), np.bincount(owner, lens, len(parts)).astype(np.int64)

    def encode(self, texts: list[str | None], rows: list[object]) -> list[np.ndarray]:
        """Piece ids of every text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        units: list[str] = []
        spans: list[tuple[int, int, int]] = []  # (text, units, place of the first)

        def flush() -> None:
            if not units:
                return
            counts = np.array([n for _, n, _ in spans])
            place = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat([p for _, _, p in spans], counts)
            key = np.repeat(np.array([self.key(rows[i]) for i, _, _ in spans], np.uint64), counts)
            codes, length = _walk(self.lat, self.lat.find(units), _mix(key + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
            edges = np.concatenate([[0], np.cumsum(length)])
            stops = np.cumsum(counts)
            ids, parts = self._expand(codes, edges[stops] - edges[stops - counts])
            for (i, _, _), some in zip(spans, np.split(ids, np.cumsum(parts)[:-1]), strict=True):
                out[i].append(some)
            units.clear()
            spans.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            own = self.v.units(" " + text)
            for a in range(0, len(own), SLICE):
                some = own[a : a + SLICE]
                if units and len(units) + len(some) > SLICE:
                    flush()
                spans.append((i, len(some), a))
                units += some
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids."""
        raw = b"".join(map(self.v.raw.__getitem__, ids.tolist()))
        return raw.decode()[1:] if raw else ""


@lru_cache(maxsize=4)
def sampler(name: str, alpha: float, seed: int) -> Sampler:
    return Sampler(name, alpha, seed)


def sample_pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    out_col: str = "piece_ids",
    check_col: str | None = None,
    model_file: str = MODEL_FILE,
    alpha: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """``docs`` without the text and with its sampled piece ids in ``out_col``.

    With ``check_col``, that column says whether decoding gave the text back. Columns of these
    names are replaced.
    """
    carried = [f for f in docs.schema.fields if f.name not in (text_col, out_col, check_col)]
    schema = T.StructType([*carried, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    if check_col:
        schema = schema.add(check_col, T.BooleanType())

    key, body = fresh("_key", docs.columns), fresh("_text", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model_file, alpha, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = batch.column(body).to_pylist()
                ids = own.encode(texts, batch.column(key).to_pylist())
                stops = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [batch.column(f.name) for f in carried]
                columns.append(pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(ids))))
                if check_col:
                    columns.append(pa.array([own.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    held = docs.select(F.col(id_col).alias(key), F.col(text_col).alias(body), *[F.col(f"`{f.name}`") for f in carried])
    return held.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, *, ids_col: str = "piece_ids", out_col: str = "text", model_file: str = MODEL_FILE) -> DataFrame:
    """``rows`` with the decoded text in ``out_col``; null ids give an empty text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sampler(model_file, 1.0, 42)
        for ids in batches:
            yield pd.Series([own.decode(np.asarray(x, np.int64)) if x is not None else "" for x in ids])

    return rows.withColumn(out_col, decoded(F.col(ids_col)))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces, lossless of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample_pieces(docs, check_col="lossless").select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "lossless")
