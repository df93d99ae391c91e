"""SentencePiece and token files against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from treeflow.llm import chunks, sentencepieces, token_files

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "  a", "a ", "a\n b", "a\n  b", " \n x", "▁x ▁▁y", "x\t y  z\n\n w", "é é  é", "　 a", "<s> </s> <|endoftext|> a<|endoftext|> b", "\x1c a\x1c  b", "a\x85 b", "😀 😀", "don't  I'll   x", "a" * 4000, "x\x00y z", "a\n", "\na", "a &&& b's ''' c.", "Ünder, \ncöver?!\nagain"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(corpus):
    return corpus + [(9000 + i, t) for i, t in enumerate(ODD)]


def test_pieces(docs_of, rows, key):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sentencepieces.splits_at_marks(PIECES)
    want = []
    for i, t, *_ in rows:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    got = [tuple(r) for r in sentencepieces.digest(docs_of(rows), PIECES).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    full = {r["doc_id"]: r for r in sentencepieces.encode_decode(docs_of(rows), PIECES).collect()}
    assert full[9003]["ids"] == [*sp.encode("a  b"), sp.eos_id()] and full[9003]["decoded"] == "a  b"
    assert sentencepieces.digest(docs_of([]), PIECES).collect() == []


@pytest.mark.parametrize("length,n_rows", [(16, 4), (2048, 512)])
def test_token_files(docs_of, rows, key, length, n_rows):
    tok = Tokenizer.from_file(BYTES)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u2").tobytes()))
    want, at = [], 0
    for i, t, *_ in ordered:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.roundtrip(docs_of(rows), BYTES, length=length, rows=n_rows).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.roundtrip(docs_of([]), BYTES).collect() == []


def test_random_access(spark, docs_of, tmp_path):
    tok = Tokenizer.from_file(BYTES)
    manifest = token_files.write_tokens(docs_of([(i, f"some words number {i} here") for i in range(50)]), BYTES, f"file://{tmp_path}", length=8, rows=3)
    for m in manifest.collect():
        reader = token_files.SequenceReader(m["file"])
        ids, mask = reader.sequence(1)
        assert len(ids) == len(mask) == 8 and (ids == reader.run(8, 8)).all() and not ids.flags.owndata
        with pytest.raises(ValueError):
            reader.run(0, 10**6)
    assert sum(m["n_docs"] for m in manifest.collect()) == 50
    assert sum(m["n_tokens"] for m in manifest.collect()) == sum(len(tok.encode(f"some words number {i} here").ids) + 1 for i in range(50))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1 \n\t.'&é▁　\x1c😀ß")), max_size=40))
def test_any_text(text):
    sp = sentencepieces._load(PIECES)
    entries = chunks.ChunkTable(lambda w: sentencepieces._segment(sp, w)).entries([sentencepieces.marked_words(text)])[0]
    assert [i for e in entries for i in e[0]] == sp.encode(text)
    tok = token_files._load(BYTES)
    enc = token_files.Encoder(tok, "H")
    found = chunks.ChunkTable(enc).entries([token_files.line_pieces(text) if text else []])[0]
    ids = enc.text(text) if text and None in found else b"".join(found)
    assert np.frombuffer(ids, "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids
