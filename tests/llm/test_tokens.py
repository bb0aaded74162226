import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import tokens

NAME = "byte_bpe_50k.json"
TOK = tokens.tokenizer(NAME)


def plain(text):
    return len(TOK.encode(text, add_special_tokens=False))


def test_written_out_pretokens_agree_with_the_library():
    own = tokens.encoder(NAME)
    for a in range(1, tokens.KNOWN, 8):
        s = "".join(f"a{ch}b {ch} {ch}{ch}  x1{ch}2!{ch}!\n{ch}\n{ch * 3} {ch}a {ch}1 {ch}! " for ch in map(chr, range(a, a + 8)))
        if own.fits(s):
            bounds, firsts = own.boundaries(s)
            assert (bounds, firsts) == tokens.chunk_boundaries(TOK, s), hex(a)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "'s", "1", "!", "é", "<|endoftext|>", "word", "字", "😀", "<|endof", "text|>"]), max_size=150), st.sampled_from([8, 20, 100]), st.sampled_from([1, 4, 64]))
def test_spliced_chunks_agree_with_whole_texts(parts, chunk, overlap):
    s = "".join(parts)
    assert tokens.count_by_chunks(s, lambda x: tokens.chunk_boundaries(TOK, x), chunk, overlap)[0] == plain(s)


@pytest.mark.parametrize("text", ["a" * 5000, "ab1 " * 3000, " " * 5000, "\n" * 3000])
def test_overlaps_widen_where_nothing_aligns(text):
    for chunk, overlap in ((100, 8), (1000, 64)):
        assert tokens.count_by_chunks(text, lambda x: tokens.chunk_boundaries(TOK, x), chunk, overlap)[0] == plain(text)


def test_edge_rows(edge, none):
    rows = tokens.count_tokens(edge, chunk_chars=1000, overlap_chars=50).collect()
    texts = sorted((r.text or "") for r in edge.collect())
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((len(t.encode()), plain(t), plain(t) > 1024) for t in texts)
    assert tokens.count_tokens(none).count() == 0


def test_random_unicode():
    rnd = random.Random(3)
    for _ in range(200):
        s = "".join(chr(rnd.choice([rnd.randint(1, 0x24F), rnd.randint(0x250, 0xD7FF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(60))
        assert tokens.count_texts([s], NAME, 20, 5)[0][0] == plain(s)


def test_whole_table_agrees_with_the_library(spark, sf):
    rows = tokens.count_tokens(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.n_tokens == plain(texts[r.doc_id]) for r in rows)
    assert sum(r.n_splices > 0 for r in rows) > 0.2 * len(rows)  # the spliced path is the usual one for longer texts
