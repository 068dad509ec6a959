"""Quality rules: a linear-chain CRF labels lines as content or boilerplate; the content share decides retention."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.llm.store import annotate, labelled_sample
from lattica.llm.text import hashes, mix, raw

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Deletes all bytes but the symbols, ASCII capitals and so on: counting by length after translate is one C pass.
NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
NOT_PUNCT = bytes(b for b in range(256) if b not in b"!?@{}[]=_~^\\/")
SPACE = bytes([9, 10, 11, 12, 13, 32])
N_FEATURES = 21


def features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_FEATURES indicators, words per line) of the lines that have a word."""
    out, sizes, seen = [], [], set()
    last = len(lines) - 1
    for i, line in enumerate(lines):
        words = line.split()
        n, chars = len(words), max(len(line), 1)
        symbols = len(line.translate(None, NOT_SYMBOLS)) / chars
        upper = len(line.translate(None, NOT_UPPER)) / chars
        digit = len(line.translate(None, NOT_DIGIT)) / chars
        punct = len(line.translate(None, NOT_PUNCT)) / chars
        distinct = len(set(words)) / n
        end = line.rstrip()[-1:]
        out.append((
            1, n <= 2, 3 <= n <= 5, 6 <= n <= 10, 11 <= n <= 40, n > 40, end in b".!?\"'" and end != b"", end == b":",
            symbols > 0.02, symbols > 0.1, upper > 0.2, upper > 0.5, digit > 0.2, punct > 0.05, punct > 0.15,
            n >= 4 and distinct < 0.7, n >= 4 and distinct < 0.4, chars / n > 15, line in seen, i == 0, i == last,
        ))
        seen.add(line)
        sizes.append(n)
    return np.array(out, float).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


@dataclass
class LineCrf:
    """State 1 is content, 0 boilerplate. ``emit``: 2 x N_FEATURES, ``move``: 2 x 2, ``start``: 2."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels; ties go to content."""
        if not len(x):
            return np.zeros(0, np.int64)
        e = (x @ self.emit.T).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + e[0][0], self.start[1] + e[0][1]
        back = []
        for e0, e1 in e[1:]:
            to0, to1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((to0, to1))
            a, b = (b + m10 if to0 else a + m00) + e0, (b + m11 if to1 else a + m01) + e1
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1], np.int64)

    def gradient(self, x: np.ndarray, y: np.ndarray, grad: LineCrf) -> None:
        """Adds the gradient of the log-likelihood (forward-backward in log space) to ``grad``."""
        e, n = x @ self.emit.T, len(x)
        f, b = np.empty((n, 2)), np.zeros((n, 2))
        f[0] = self.start + e[0]
        for i in range(1, n):
            f[i] = np.logaddexp(f[i - 1, 0] + self.move[0], f[i - 1, 1] + self.move[1]) + e[i]
        for i in range(n - 2, -1, -1):
            t = b[i + 1] + e[i + 1]
            b[i] = np.logaddexp(self.move[:, 0] + t[0], self.move[:, 1] + t[1])
        z = np.logaddexp(f[-1, 0], f[-1, 1])
        p = np.exp(f + b - z)
        hot = np.eye(2)[y]
        grad.emit += (hot - p).T @ x
        grad.start += hot[0] - p[0]
        if n > 1:
            pair = np.exp(f[:-1, :, None] + self.move[None] + (b[1:] + e[1:])[:, None, :] - z)
            grad.move += np.einsum("ni,nj->ij", hot[:-1], hot[1:]) - pair.sum(axis=0)


def lines_of(text: str | None) -> list[bytes]:
    return [x for x in raw(text).split(b"\n") if x.split()]


def fresh_lines(lines: list[bytes]) -> np.ndarray:
    """1 for a line's first occurrence in its text, 0 for a repeat."""
    seen: set[bytes] = set()
    return np.array([0 if x in seen else (seen.add(x), 1)[1] for x in lines], np.int64)


def relabelled(crf: LineCrf, x: np.ndarray, sizes: np.ndarray, least_share: float) -> np.ndarray:
    """Line labels of a bad document: the likeliest ones by ``crf``, among those by which it would not be kept.

    Where its content would reach ``least_share`` of the words, the lines least like content turn into boilerplate, in
    that order, until it no longer does.
    """
    label = crf.viterbi(x)
    words = sizes.sum()
    if (label * sizes).sum() >= least_share * words:
        odds = x @ (crf.emit[1] - crf.emit[0])
        for i in np.lexsort((np.arange(len(x)), odds)).tolist():
            label[i] = 0
            if (label * sizes).sum() < least_share * words:
                break
    return label


def fit_lines(documents: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rounds: int = 3, least_share: float = 0.5) -> LineCrf:
    """The CRF from documents (features, words a line, first occurrences, 0/1 quality), whose lines have no labels of their own.

    Hard expectation maximisation: lines of good documents are content but for repeats. Those of bad ones start as
    boilerplate in a model of single lines, without transitions; then, and after each fit of the chain, they take the
    likeliest labels by which the document is still rejected. So prose in a bad document becomes content and the
    transitions between the kinds are learned.
    """
    labels = [first * quality for _, _, first, quality in documents]
    crf = fit([(x[i : i + 1], y[i : i + 1]) for (x, _, _, _), y in zip(documents, labels, strict=True) for i in range(len(y))], epochs=2)
    for _ in range(rounds):
        labels = [y if quality else relabelled(crf, x, sizes, least_share) for (x, sizes, _, quality), y in zip(documents, labels, strict=True)]
        crf = fit([(x, y) for (x, _, _, _), y in zip(documents, labels, strict=True)], epochs=3)
    return crf


def fit(documents: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-3, seed: int = 7, crf: LineCrf | None = None) -> LineCrf:
    """AdaGrad ascent on the conditional log-likelihood, from ``crf`` or zero. Without documents every line is content."""
    shapes = ((2, N_FEATURES), (2, 2), (2,))
    if crf is None:
        crf = LineCrf(*(np.zeros(s) for s in shapes))
        crf.start[1] = 1e-9
    total = [np.full(s, 1e-6) for s in shapes]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(documents))
        for at in range(0, len(order), 16):
            grad = LineCrf(*(np.zeros(s) for s in shapes))
            part = order[at : at + 16]
            for i in part:
                crf.gradient(*documents[i], grad)
            for w, g, t in zip((crf.emit, crf.move, crf.start), (grad.emit, grad.move, grad.start), total):
                g = g / len(part) - l2 * w
                t += g * g
                w += rate * g / np.sqrt(t)
    return crf


def train(docs: DataFrame, labels: DataFrame, bound: int = 3_000, **how) -> LineCrf:
    """Fit on at most ``bound`` labelled documents; the driver gets line indicators, never texts.

    Null ids, labels and texts and texts without words are left out; contradicting labels of an id count as good.
    """
    fields = T.StructType([T.StructField("x", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("first", T.BinaryType())])

    def fn(texts):
        rows = []
        for t in texts:
            lines = lines_of(t)
            x, sizes = features(lines)
            rows.append((x.astype(np.int8).tobytes(), sizes.tobytes(), fresh_lines(lines).astype(np.int8).tobytes()))
        return list(zip(*rows, strict=True))

    got = annotate(labelled_sample(docs, labels, "quality", None, bound), fn, fields, ("doc_id", "y")).toPandas().sort_values("doc_id", kind="stable")
    data = []
    for x, sizes, first, y in zip(got["x"], got["sizes"], got["first"], got["y"]):
        if n := len(first):
            data.append((np.frombuffer(x, np.int8).reshape(n, N_FEATURES).astype(float), np.frombuffer(sizes, np.int64), np.frombuffer(first, np.int8).astype(np.int64), int(y)))
    return fit_lines(data, **how)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = hashes(words)
    w = mix(mix(h[:-2] + np.uint64(1)) + h[1:-1])
    w = mix(w + h[2:])
    _, inverse, count = np.unique(w, return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    cover = np.zeros(n, bool)
    for i in range(3):
        cover[i : n - 2 + i] |= hit
    return int(cover.sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for null and empty texts."""
    data = raw(text)
    words = data.split()
    blank = len(data) - len(data.translate(None, SPACE))
    dup = sum(n - 1 for n in Counter(x for x in data.split(b"\n") if x.split()).values())
    return len(words), len(text or "") - blank, len(data.translate(None, NOT_SYMBOLS)), dup, repeated_words(words)


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("n_content_lines", T.LongType())]
)


def judge(text: str | None, crf: LineCrf, least_share: float = 0.5) -> tuple:
    stats = statistics(text)
    x, sizes = features(lines_of(text))
    label = crf.viterbi(x)
    share = float((label * sizes).sum() / sizes.sum()) if sizes.sum() else 0.0
    failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
    return (*stats, failed, not failed and share >= least_share, share, int(label.sum()))


def line_rules(docs: DataFrame, crf: LineCrf, keep: tuple[str, ...] = ("doc_id",), least_share: float = 0.5) -> DataFrame:
    """``keep`` columns plus the statistics, ``base_failed``, ``kept``, the words' share in content lines and their number.

    Null and empty texts have no words, fail the base rule and are not kept. Lines of a text are decoded together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    return annotate(docs, lambda texts: list(zip(*(judge(t, shared.value, least_share) for t in texts), strict=True)), RESULT, keep)


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a document, repeats included, by the model of all its labelled sample; an empty table gives none. Without labels
    every line is content. Other columns are left out, whatever their names."""
    return line_rules(docs, train(docs, labels))
