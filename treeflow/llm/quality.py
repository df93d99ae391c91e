"""Quality rules: a linear-chain CRF marks each line as content or boilerplate; the content share decides."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, as_bytes, batch, columns, lean

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: A document is kept when at least this share of its words lies in content lines.
CONTENT_SHARE = 0.5
#: Documents whose lines train the model, at most in expectation; in all, at most one and a half times as many.
SAMPLE_ROWS = 400
#: Consecutive lines of one document that train the model, at most, from a place that the text's hash picks; labelling
#: always covers all lines.
SAMPLE_LINES = 200
N_FEATURES = 9
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
_UTF8_INNER = bytes(range(0x80, 0xC0))


# --- base figures ----------------------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur at least twice in the list, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(31)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    # of windows with one hash, each is compared with the one before it, word by word; ids of words keep that cheap
    exact = same & _alike(words, order[1:], order[:-1], same)
    if (exact != same).any():  # two hashes met by chance: compare all of them
        return _covered(len(words), _by_words(words, np.flatnonzero(_either(order, same, n))))
    return _covered(len(words), np.flatnonzero(_either(order, same, n)))


def _either(order: np.ndarray, same: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _alike(words: list[bytes], a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether windows at a and b hold the same words, where asked."""
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(asked)
    out[at] = [words[i : i + WINDOW] == words[j : j + WINDOW] for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)]
    return out


def _by_words(words: list[bytes], at: np.ndarray) -> np.ndarray:
    """Those windows of at whose words another of them holds."""
    places: dict[tuple, list[int]] = {}
    for i in at.tolist():
        places.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    return np.array([i for x in places.values() if len(x) > 1 for i in x], np.int64)


def _covered(n: int, at: np.ndarray) -> int:
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def _lines(raw: bytes) -> list[bytes]:
    """Lines with a word."""
    return [x for x in raw.split(b"\n") if x and not x.isspace()]


def base_figures(raw: bytes, words: list[bytes], lines: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    solid = raw.translate(None, SPACES)
    chars = len(solid.translate(None, _UTF8_INNER))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, failed


# --- lines as sequences ----------------------------------------------------------------------------------------


def line_features(lines: list[bytes]) -> np.ndarray:
    """One row for each line: bias, length, symbols, capitals, digits, repeated words, seen before, marks, short words."""
    out = np.zeros((len(lines), N_FEATURES))
    seen: set[bytes] = set()
    for i, x in enumerate(lines):
        words = x.split()
        n = len(x)
        upper = n - len(x.translate(None, _UPPER))
        lower = n - len(x.translate(None, _LOWER))
        marks = n - len(x.translate(None, b"!?{}[]=;\\/_~"))
        out[i] = (1.0, min(len(words), 30) / 30, min(1.0, 10 * (n - len(x.translate(None, SYMBOLS))) / n), upper / (upper + lower + 8), (n - len(x.translate(None, _DIGITS))) / n, 1 - len(set(words)) / len(words), x in seen, min(1.0, 10 * marks / n), len(words) < 3)
        seen.add(x)
    return out


def seed_labels(f: np.ndarray) -> np.ndarray:
    """Labels to learn from: 1 is content. Clear marks of junk in a line make it boilerplate."""
    junk = (f[:, 2] >= 0.5) | (f[:, 3] > 0.6) | (f[:, 4] > 0.4) | ((f[:, 5] > 0.75) & (f[:, 1] > 0.4)) | (f[:, 7] >= 0.8)
    return 1 - junk.astype(np.int64)


@dataclass
class LineModel:
    """Weights of the chain: emissions (2, features) and transitions (2, 2). Label 1 is content."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((2, N_FEATURES)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def viterbi(self, f: np.ndarray) -> np.ndarray:
        """The most probable labels; ties go to content."""
        scores = (f @ self.emit.T).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back, a, b = [], 0.0, 0.0
        for i, (s0, s1) in enumerate(scores):
            if i:
                x00, x10, x01, x11 = a + m00, b + m10, a + m01, b + m11
                back.append((1 if x10 >= x00 else 0, 1 if x11 >= x01 else 0))
                a, b = max(x00, x10) + s0, max(x01, x11) + s1
            else:
                a, b = s0, s1
        label = 1 if b >= a else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1] if scores else [], np.int64)

    def gradient(self, f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log likelihood, by forward and backward sums; and the likelihood itself."""
        s = f @ self.emit.T
        n = len(s)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = s[0]
        for i in range(1, n):
            alpha[i] = np.logaddexp(alpha[i - 1][0] + self.move[0], alpha[i - 1][1] + self.move[1]) + s[i]
        for i in range(n - 2, -1, -1):
            nxt = s[i + 1] + beta[i + 1]
            beta[i] = np.logaddexp(self.move[:, 0] + nxt[0], self.move[:, 1] + nxt[1])
        total = np.logaddexp(*alpha[-1])
        p = np.exp(alpha + beta - total)
        truth = np.eye(2)[y]
        emit = (truth - p).T @ f
        move = np.zeros((2, 2))
        if n > 1:
            np.add.at(move, (y[:-1], y[1:]), 1)
            move -= np.exp(alpha[:-1, :, None] + self.move[None] + (s[1:] + beta[1:])[:, None, :] - total).sum(axis=0)
        return emit, move, float((truth * s).sum() + sum(self.move[a, b] for a, b in zip(y[:-1], y[1:], strict=True)) - total)


def fit_lines(sequences: list[np.ndarray], *, epochs: int = 4, rate: float = 0.5) -> LineModel:
    """Gradient ascent, one document at a time, in the order given."""
    model = LineModel(np.array([np.full(N_FEATURES, -0.1), np.full(N_FEATURES, 0.1)]))
    model.emit[:, 1:] = 0
    for e in range(epochs):
        for f in sequences:
            if len(f):
                emit, move, _ = model.gradient(f, seed_labels(f))
                step = rate / (1 + e) / len(f) ** 0.5
                model.emit += step * (emit - 1e-3 * model.emit)
                model.move += step * (move - 1e-3 * model.move)
    return model


#: Lines that stand in where a sample lacks one kind: plain prose, and lines of symbols, capitals and repeats.
_PRIMER = [
    [b"It was a long walk along the river, and nobody said a word until we reached the bridge.", b"The mill had been closed for years.", b"Only the wheel still turned when the water was high in spring, they told us.", b"Nobody had lived there since."],
    [b"### menu ### home ### about ### contact ###", b"home | news | about | login | help | terms", b"BUY NOW!! BEST PRICE!! LIMITED OFFER!! CLICK HERE TO SAVE!!", b"free free free free free free free free free free free free free free free"],
]


def _stretch(f: np.ndarray, h: int) -> np.ndarray:
    """At most SAMPLE_LINES consecutive lines from anywhere in a text."""
    start = h % (len(f) - SAMPLE_LINES + 1) if len(f) > SAMPLE_LINES else 0
    return f[start : start + SAMPLE_LINES]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> LineModel:
    """Fit the chain on the lines of a bounded sample of documents, picked by a hash of the text, and a few fixed lines.

    The driver gets features only: at most 1.5 x sample_rows sequences of SAMPLE_LINES lines. Null texts do not count,
    equal texts count once, and an empty table gives the model of the fixed lines.
    """
    d = columns(docs, text=text_col).where("text is not null")
    n = d.count()
    rows = []
    if n:
        h = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
        picked = d.select(h.alias("h"), "text").where(F.col("h") < min(1.0, 1.15 * sample_rows / n) * (1 << 30))

        def features(batches):
            for b in batches:
                found = [_stretch(line_features(_lines(x)), h) for h, x in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.reshape(-1).tolist() for f in found], pa.list_(pa.float64()))], names=["h", "f"])

        # equal texts have one hash, so a group of copies counts once
        bags = picked.mapInArrow(lean(features), "h long, f array<double>").dropDuplicates(["h"])
        rows = [np.array(r["f"]).reshape(-1, N_FEATURES) for r in bags.orderBy("h").limit(int(1.5 * sample_rows)).collect()]
    return fit_lines([line_features(x) for x in _PRIMER] + rows + [line_features(x) for x in _PRIMER])


def _share(model: LineModel, lines: list[bytes]) -> float:
    """The share of words that lies in content lines."""
    size = np.array([len(x.split()) for x in lines])
    return float(size[model.viterbi(line_features(lines)) == 1].sum() / size.sum())


def assess(docs: DataFrame, model: LineModel, *, id_col: str = "doc_id", text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """Base figures and the verdict on each row.

    kept is False where the base rules fail, else whether content lines hold at least ``content_share`` of the words.
    A null text has no words, so it fails; null ids and equal rows stay as they are; an empty table gives an empty one.
    """

    def run(batches):
        for b in batches:
            rows = []
            for raw in as_bytes(b.column(1)):
                raw = raw or b""
                words, lines = raw.split(), _lines(raw)
                figures = base_figures(raw, words, lines)
                share = 0.0
                if not figures[-1]:
                    share = _share(model, lines)
                rows.append((*figures, not figures[-1] and share >= content_share, share))
            yield batch(_OUT, b.column(0), *[list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 8)

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(lean(run), _DDL)


def keep(docs: DataFrame, model: LineModel, *, text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows that ``assess`` keeps, with all their columns; null texts go, and an empty table stays empty."""
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            kept = []
            for raw in as_bytes(b.column(place)):
                raw = raw or b""
                words, lines = raw.split(), _lines(raw)
                kept.append(not base_figures(raw, words, lines)[-1] and _share(model, lines) >= content_share)
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
