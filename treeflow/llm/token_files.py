"""Token ids in Arrow files: batches of fixed-size lists with masks, read back by position."""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from .chunks import ChunkTable
from .common import batch, columns, partitions, scratch, scratch_path, slices

#: Characters that no tokenizer pattern treats as white space; a space after one of them starts a new chunk.
_OTHER_BEFORE_SPACE = re.compile(r"[^\w!-~] ")
_SOLID = re.compile(r"[\w!-~]")
#: One run of letters from long-settled blocks of Unicode, and perhaps ASCII punctuation after it.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f]+)([!-/:-@\[-`{-~]*)")
#: Pieces, and words without their punctuation, that a worker's tables hold before they are emptied.
KEEP = 400_000
_TOKENS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("index_file", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
_READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


@functools.lru_cache(maxsize=2)
def _load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}


def line_pieces(text: str) -> list[str]:
    """The text cut at spaces and newlines, as keys that tell what stood before each piece.

    A piece that begins the text has a space before it, one that begins a line has a newline; the others followed a
    space. (Pieces hold neither, so keys are unambiguous.)
    """
    out: list[str] = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        out.append("\n" + first)
        out += rest
    out[0] = " " + out[0][1:]
    return out


class Encoder:
    """Ids of the distinct keys of ``line_pieces``, as bytes of a little-endian array.

    None where a piece has white space (or what may count as such) at an end: then pieces of that text do not stand
    alone. A piece of letters with perhaps punctuation after it is one or two words of the tokenizer's pattern, so the
    library's model gets these directly, without the cost of offsets and masks. All other pieces go through the
    library's whole encoder.
    """

    def __init__(self, tok: Tokenizer, kind: str):
        self.tok, self.kind, self.letters = tok, kind, _byte_letters()
        spec = json.loads(tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.alone = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not any(re.search(r"\s", x["content"]) for x in spec["added_tokens"])
        self.direct = self.alone and not any(re.search("[A-Za-z]", x["content"]) and _PLAIN.fullmatch(x["content"]) for x in spec["added_tokens"])
        self.marks = {"": b""}
        self.words: dict[str, bytes] = {}
        self.newline = self.model("\n")

    def model(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.tok.model.tokenize(mapped)]).tobytes()

    def __call__(self, keys: list[str]) -> list[bytes | None]:
        out: list[bytes | None] = [None] * len(keys)
        rest, words = [], self.words
        if len(words) > KEEP:
            words.clear()
        for i, key in enumerate(keys):
            begins = key[:1] if key[:1] in (" ", "\n") else ""
            piece = key[len(begins) :]
            if self.direct and (m := _PLAIN.fullmatch(piece)):
                word, marks = m[1], m[2]
                if marks not in self.marks:
                    self.marks[marks] = self.model(marks)
                word = word if begins else " " + word
                ids = words.get(word)
                if ids is None:
                    ids = words[word] = self.model(word)
                out[i] = (self.newline + ids if begins == "\n" else ids) + self.marks[marks]
            elif piece and _SOLID.match(piece[0]) and _SOLID.match(piece[-1]):
                rest.append((i, begins, piece if begins else " " + piece))
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        for (i, begins, _), ids in zip(rest, self.whole([x[2] for x in rest]), strict=True):
            out[i] = self.newline + ids if begins == "\n" else ids
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for k in range(0, len(texts), 2000) for e in self.tok.encode_batch_fast(texts[k : k + 2000], add_special_tokens=False)]

    def text(self, text: str) -> bytes:
        """A text whose pieces do not stand alone: by larger chunks, each distinct one once."""
        chunks = spaced_chunks(text) if self.alone else [text]
        distinct = list(set(chunks))
        return b"".join(map(dict(zip(distinct, self.whole(distinct), strict=True)).__getitem__, chunks))


@functools.lru_cache(maxsize=2)
def _table(path: str, kind: str) -> ChunkTable:
    """A worker's table of pieces, kept from task to task and bounded by KEEP."""
    return ChunkTable(Encoder(_load(path), kind), keep=KEEP)


def spaced_chunks(text: str) -> list[str]:
    """Chunks that a byte-level pattern tokenizer treats alike alone and in the text.

    The pattern never joins a character that is not white space with a space after it, so the text is cut before
    each space that follows such a character.
    """
    pieces = text.split(" ")
    if len(pieces) == 1:
        return pieces if text else []
    if text[0] != " " and not _OTHER_BEFORE_SPACE.search(text):
        return [pieces[0], *[" " + p for p in pieces[1:]]]
    out, last = [pieces[0]], pieces[0][-1:]
    for p in pieces[1:]:
        if last and _SOLID.match(last):
            out.append(" " + p)
        else:
            out[-1] += " " + p
        last = p[-1:] or " "
    return out


def tokenized(docs: DataFrame, path: str, bounds: list[int], end_id: int, width: str, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, doc_id, ids): part is the range of doc_id in ``bounds``, ids a little-endian array."""

    def run(batches):
        table = _table(path, "H" if width == "<u2" else "I")
        encoder = table.encode
        end, cuts = np.array([end_id], dtype=width).tobytes(), np.array(bounds, dtype=np.int64)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            keys = b.column(0)
            part = np.where(np.array(keys.is_null()), 0, np.searchsorted(cuts, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right"))
            for i, j in slices(len(texts), [len(t) for t in texts], 1_000_000):
                entries = table.entries([line_pieces(t) if t and encoder.alone else [] for t in texts[i:j]])
                ids = [encoder.text(t) if t and (not es or None in es) else b"".join(es) for t, es in zip(texts[i:j], entries, strict=True)]
                yield batch(_TOKENS, part[i:j], keys.slice(i, j - i), [x + end for x in ids])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "part int, doc_id long, ids binary")


def _writer(root: str, length: int, width: str, rows: int):
    kind = pa.from_numpy_dtype(np.dtype(width))
    schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
    index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    class Shard:
        def __init__(self, part: int):
            self.store, at = fs.FileSystem.from_uri(root)
            self.store.create_dir(at, recursive=True)
            self.names = [f"{root}/part-{part:06d}-{uuid.uuid4().hex}{x}.arrow" for x in ("", ".index")]
            self.sinks = [self.store.open_output_stream(f"{at}/{n.rpartition('/')[2]}") for n in self.names]
            self.files = [pa.ipc.new_file(s, k) for s, k in zip(self.sinks, (schema, index), strict=True)]
            self.part, self.total, self.docs, self.rest, self.held = part, 0, 0, [], 0

        def add(self, keys: pa.Array, ids: list[bytes]) -> None:
            size = np.dtype(width).itemsize
            n = np.array([len(x) // size for x in ids], dtype=np.int64)
            start = self.total + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
            self.files[1].write_batch(batch(index, keys, start, n))
            self.total, self.docs = self.total + int(n.sum()), self.docs + len(n)
            self.rest += ids
            self.held += int(n.sum())
            if self.held >= rows * length:
                self.flush(last=False)

        def flush(self, last: bool) -> None:
            values, size = np.frombuffer(b"".join(self.rest), dtype=width), rows * length
            whole = len(values) // size * size
            for i in range(0, whole, size):  # all batches but the last have the same number of rows
                self.put(values[i : i + size], size)
            rest = values[whole:]
            if last and len(rest):
                self.put(np.concatenate([rest, np.zeros(-len(rest) % length, width)]), len(rest))
                rest = rest[:0]
            self.rest, self.held = [rest.tobytes()], len(rest)

        def put(self, values: np.ndarray, filled: int) -> None:
            mask = np.arange(len(values)) < filled
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (values, mask)]
            self.files[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))

        def close(self) -> pa.RecordBatch:
            self.flush(last=True)
            for f in (*self.files, *self.sinks):
                f.close()
            return batch(_MANIFEST, [self.part], [self.names[0]], [self.names[1]], [self.total], [self.docs])

    def run(batches):
        shard = None
        for b in batches:
            part = b.column(0).to_numpy()
            for i, j in zip(np.flatnonzero(np.diff(part, prepend=-1)), [*np.flatnonzero(np.diff(part)) + 1, len(part)], strict=True) if len(part) else ():
                if shard is None or shard.part != part[i]:
                    if shard is not None:
                        yield shard.close()
                    shard = Shard(int(part[i]))
                shard.add(b.column(1).slice(i, j - i), b.column(2).slice(i, j - i).to_pylist())
        if shard is not None:
            yield shard.close()

    return run


class SequenceReader:
    """Random access to one shard: rows of equal length, their masks, and any run of ids by position.

    A local file is mapped into memory, so a row or a run within one batch is a view of the file's own bytes.
    """

    def __init__(self, uri: str):
        store, at = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        kind = self.file.schema.field("ids").type
        self.length, self.dtype = kind.list_size, kind.value_type.to_pandas_dtype()
        self.rows, self.at, self.now = [], -1, None
        self.batch_rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def values(self, k: int) -> np.ndarray:
        if k != self.at:
            ids = self.file.get_batch(k).column(0)
            self.now = ids.values.to_numpy(zero_copy_only=True)[ids.offset * self.length : (ids.offset + len(ids)) * self.length]
            self.at = k
        return self.now

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        k, r = divmod(row, self.batch_rows)
        mask = self.file.get_batch(k).column(1).values.to_numpy(zero_copy_only=False)
        return self.values(k)[r * self.length : (r + 1) * self.length], mask[r * self.length : (r + 1) * self.length]

    def run(self, start: int, n: int) -> np.ndarray:
        per, found = self.batch_rows * self.length, []
        while n > 0:
            k, i = divmod(start, per)
            found.append(self.values(k)[i : i + n])
            if not len(found[-1]):
                raise ValueError(f"ids end before {start + n}")
            start, n = start + len(found[-1]), n - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, self.dtype)


def _read(batches):
    for b in batches:
        for part, name, index_name in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            reader = SequenceReader(name)
            store, at = fs.FileSystem.from_uri(index_name)
            with store.open_input_file(at) as f:
                index = pa.ipc.open_file(f)
                for k in range(index.num_record_batches):
                    x = index.get_batch(k)
                    crc = [zlib.crc32(reader.run(s, n).astype("<u4").tobytes()) for s, n in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)]
                    yield batch(_READ, [part] * len(crc), x.column(0), x.column(1), x.column(2), crc)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, *, end_id: int = 0, length: int = 2048, rows: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ids in ascending id order to Arrow files under ``out``; returns the manifest, one row for each file.

    Each file has the documents of one range of ids; its ids run on from document to document in rows of ``length``,
    the last row filled up with zeros that its mask marks False. Beside it lies an index file (doc_id, start, n_tokens).
    The element type is the narrowest that holds the vocabulary. Names are unique to an attempt and only files of the
    manifest are read, so a task that runs twice does no harm. A null text counts as empty (the end id alone); null
    ids come first; rows that share an id are ordered by their ids' bytes.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    width = "<u2" if _load(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    keys = docs.select(docs[id_col].cast("long").alias("doc_id"))
    cuts = [i / n for i in range(1, n)]
    found = keys.agg(F.percentile_approx("doc_id", cuts, 10 * max(n, 1000)).alias("b")).first()["b"] if cuts else None
    bounds = sorted(set(found or []))
    tokens = tokenized(docs, tokenizer_path, bounds, end_id, width, id_col, text_col)
    sorted_ = tokens.repartitionById(n, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    return scratch(sorted_.mapInArrow(_writer(out, length, width, rows), "part int, file string, index_file string, n_tokens long, n_docs long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the manifest's files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    offsets = manifest.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    rows = manifest.select("part", "file", "index_file").repartitionById(partitions(manifest.sparkSession), "part").mapInArrow(_read, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write to a fresh folder in the shared place and read back."""
    return read_tokens(write_tokens(docs, tokenizer_path, scratch_path(docs.sparkSession, "tokens"), **options))
