from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import pieces

S = pieces.Sampler()
SP = pieces.processor(pieces.MODEL_FILE)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "▁", "é", "😀", "字", "\t", "ing", "X1", "</s>", "\x00", ","]), max_size=30).map("".join), st.text(max_size=40)), st.integers(0, 99))
def test_decoding_is_lossless_and_repeatable(text, key):
    ids = S.encode([text], [key])[0]
    assert S.decode(ids) == text and SP.decode(ids.tolist()) == text
    assert pieces.Sampler().encode(["x y", text], [1, key])[1].tolist() == ids.tolist() if key == 0 else True


def segmentations(unit):
    if not unit:
        return {(): 1.0}
    out = {}
    for e in range(1, len(unit) + 1):
        if (i := S.v.ids.get(unit[:e])) is not None:
            for rest, w in segmentations(unit[e:]).items():
                out[(i, *rest)] = w * S.v.weight[i]
    return out


def test_sampling_has_the_lattices_distribution():
    for word in ("then", "ering", "nation"):
        want = segmentations("▁" + word)
        z, n = sum(want.values()), 30_000
        got = Counter(tuple(x.tolist()) for x in S.encode([word] * n, list(range(n))))
        assert set(got) <= set(want)
        assert max(abs(got[k] / n - w / z) for k, w in want.items()) < 0.015


def test_batched_and_plain_forward_passes_agree():
    for unit in (" then", "ing", " ", "a", "  ", " nationality"):
        lat = pieces.Lattices(S.v)
        end = int(lat.find([unit])[0])
        edges = pieces.forward(unit.replace(" ", pieces.SPACE), S.v)
        for p, node in enumerate(edges):
            k = end - len(edges) + 1 + p
            first, last = lat.first[k], lat.first[k + 1] if k + 1 < lat.nodes else lat.edges
            assert lat.code[first:last].tolist() == [x for _, _, x in node]
            assert np.allclose(lat.upto[first : last - 1], np.cumsum([w for w, _, _ in node])[:-1])


def test_long_units_and_small_stores(monkeypatch):
    text = "ab" * 20_000 + "字" * 500 + " x" * 5000
    ids = S.encode([text], [1])[0]
    assert S.decode(ids) == text
    monkeypatch.setattr(pieces, "KEPT_EDGES", 500)
    monkeypatch.setattr(pieces, "KEPT_UNITS", 20)
    monkeypatch.setattr(pieces, "SLICE", 64)
    assert pieces.Sampler().encode([text], [1])[0].tolist() == ids.tolist()


def test_edge_rows(edge, none):
    out = pieces.sample_pieces(edge, check_col="ok")
    rows = out.collect()
    assert len(rows) == edge.count() and all(r.ok for r in rows)
    assert all((len(r.piece_ids) == 0) == (r.doc_id in (2, 3) or r.doc_id is None and r.lang is None) for r in rows)
    back = pieces.decode_pieces(out).collect()
    assert sorted((r.text or "") for r in edge.collect()) == sorted(r.text for r in back)
    assert pieces.sample_pieces(none).count() == 0
