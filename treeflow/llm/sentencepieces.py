"""SentencePiece encoding and decoding with a table of distinct marked words."""

from __future__ import annotations

import functools
import hashlib
import re
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .chunks import ChunkTable
from .common import batch, columns, lean, slices

MARK = "▁"
_RUN = re.compile(" +[^ ]*")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


@functools.lru_cache(maxsize=2)
def _load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def splits_at_marks(path: str) -> bool:
    """Whether chunks can be segmented alone: a dummy prefix, no white space removed, and a mark only at a piece's start.

    The normalizer is probed: it must leave characters as they are and turn each space into a mark.
    """
    sp = _load(path)
    probe = "a  b\tc\nd é "
    return sp.normalize(probe) == MARK + probe.replace(" ", MARK) and not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


def marked_words(text: str) -> list[str]:
    """The text's marked words, each without its first mark (which the library puts back as its dummy prefix)."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [x[1:] for x in _RUN.findall(" " + text)]
    return text.split(" ")


def _segment(sp: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[tuple[list[int], str]]:
    alone = sp.piece_to_id(MARK)
    ids = [x if w else [alone] for w, x in zip(words, sp.encode(words, num_threads=1), strict=True)]
    return [(x, " ".join(map(str, x))) for x in ids]


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode_decode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids (with the end id last) and the decoded text of each row.

    A null text counts as empty and gets the end id alone; a null id stays null; equal rows are kept as they are;
    an empty table gives an empty one. Other columns are not read, so their names do not matter.
    """

    def run(batches):
        for b, part, entries, sp in _walk(batches, model_path):
            ids = [[*chain.from_iterable(e[0] for e in es), sp.eos_id()] for es in entries]
            yield batch(_SCHEMA, part.column(0), ids, sp.decode(ids, num_threads=1) if ids else [])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, but only the number of ids and the digests of ids and decoded text leave the task."""

    def run(batches):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for _, part, entries, sp in _walk(batches, model_path):
            end = sp.eos_id()
            ids = [[*chain.from_iterable([e[0] for e in es]), end] for es in entries]
            said = [sha(" ".join([*[e[1] for e in es], str(end)])) for es in entries]
            yield batch(_DIGEST, part.column(0), [len(x) for x in ids], said, [sha(x) for x in sp.decode(ids, num_threads=1)] if ids else [])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _walk(batches, model_path: str):
    sp = _load(model_path)
    table = ChunkTable(functools.partial(_segment, sp))
    alone = splits_at_marks(model_path)
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
        for i, j in slices(b.num_rows, sizes, 1_000_000):  # a batch's texts become Python's slice by slice
            part = b.slice(i, j - i)
            texts = _texts(part.column(1))
            if alone:
                entries = table.entries([marked_words(t) for t in texts])
            else:  # a model whose pieces cross marks: whole texts are the chunks
                entries = [[(x, " ".join(map(str, x)))] if x else [] for x in sp.encode(texts, num_threads=1)]
            yield b, part, entries, sp
