"""LM scoring by a probabilistic suffix tree: word contexts with the counts of the whole corpus over a tree of bytes.

A text is a sequence of words and an end. The longest suffix state predicts a word, smoothed towards the next shorter
one: first the word before it, if it is a state, P(w | u) = (c(u, w) + b P(w)) / (c(u) + b) with
b = KAPPA + c(u), so that the root keeps at least half; then the root, P(w) = (c(w) + kinds S(w)) / (N + kinds), N words of
that many kinds; then S, the word's spelling. These counts are a table as large as the corpus's words and word pairs. It
is never collected: blocks of documents ask for their words and pairs. A word u is a state if it passes the divergence test
that bytes pass: with A(u), the mean of ln(P(w | u) / P(w)) over the words w that follow u in the corpus, A(u) is at least
the divergence asked for and c(u) A(u) at least ln(N). Where b / (c(u) + b) is r, (1 - r) A(u) is KL(P(. | u), P) +
r KL(P, P(. | u)): never negative, and 0 only if u predicts what the root does. The blocks add up their parts of c(u) A(u)
in a second exchange. The spelling is predicted byte by byte from a
context of up to ``DEPTH`` bytes, from a blank to the next one, by a tree trained on whole texts (lower-cased, words joined
by single spaces, closed by an end symbol). A context of bytes is a state if it makes up at least ``P_MIN`` of the corpus
and a divergence test tells its next-symbol distribution from its suffix's, or if a longer state needs it as a suffix.
That tree is the small, broadcast part of the model.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm.store import fold, save, save_dealt
from lattica.llm.text import hashes, mix, space_words

DEPTH = 5
#: Least share of the corpus of a context, and of a context with its next symbol: they bound the states of a level by
#: 1 / P_MIN and its transitions by 1 / P_PAIR, whatever the corpus, and so what is collected and broadcast.
P_MIN, P_PAIR = 1e-5, 1e-6
END = b"\n"
#: Spellings are kept to 1 / STEPS of a power of ten, down to 10 ** -256.
STEPS = 128
#: The weight of the root's prediction beside a word context's counts is this and the counts' sum.
KAPPA = 2.0
#: Least divergence of a state from its suffix, in nats, and parts of a nat that words' gains are rounded to: sums of such
#: do not depend on how the documents fall into blocks.
DIVERGENCE, NAT = 0.005, 1024
#: The context of a text's first word, and a factor for pairs' hashes.
START, ODD = np.uint64(0x5851F42D4C957F2C), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words that are spelled at once (one word at least): the arrays take about a hundred times as many.
SPELL_BYTES = 1 << 18
#: What precedes a word that is spelled by itself: bytes that no text's words hold, and a blank.
PAD = b"\t" * (DEPTH - 1) + b" "
MASKS = [np.int64((1 << (8 * n)) - 1) for n in range(DEPTH + 2)]


def grams(words: list[bytes]) -> np.ndarray:
    """The ``DEPTH`` + 1 byte windows that end at each predicted byte, packed into longs; the start is padded with ends."""
    data = np.frombuffer(END * DEPTH + b" ".join(words) + END, np.uint8).astype(np.int64)
    n = len(data) - DEPTH
    out = np.zeros(n, np.int64)
    for i in range(DEPTH + 1):
        out = (out << np.int64(8)) | data[i : i + n]
    return out


@dataclass
class SuffixTree:
    """Per length L: sorted states, log10 of their backoff weights, sorted transitions (state and symbol) and their log10
    probabilities. A transition that a state lacks costs its weight and the suffix's transition."""

    states: list[np.ndarray]
    weights: list[np.ndarray]
    pairs: list[np.ndarray]
    logs: list[np.ndarray]
    symbols: np.ndarray

    def gram_logs(self, gram: np.ndarray) -> np.ndarray:
        """log10 P(last byte | longest state that is a suffix of the bytes before it)."""
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        for n in range(len(self.states) - 1, 0, -1):
            if not len(self.states[n]):
                continue
            g = gram[todo]
            context = (g >> np.int64(8)) & MASKS[n]
            at = np.minimum(np.searchsorted(self.states[n], context), len(self.states[n]) - 1)
            here = self.states[n][at] == context
            pair = g & MASKS[n + 1]
            to = np.minimum(np.searchsorted(self.pairs[n], pair), len(self.pairs[n]) - 1) if len(self.pairs[n]) else None
            known = here & (self.pairs[n][to] == pair) if to is not None else np.zeros(len(g), bool)
            if to is not None:
                out[todo[known]] += self.logs[n][to[known]]
            back = here & ~known
            out[todo[back]] += self.weights[n][at[back]]
            todo = todo[~known]
        out[todo] += self.symbols[gram[todo] & np.int64(255)]
        return out

    def spell(self, words: list[bytes]) -> np.ndarray:
        """log10 of the tree's probability of each word, spelled from a blank to the next; the end symbol is ``END``."""
        part = np.cumsum([len(w) for w in words], dtype=np.int64) // SPELL_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
        return np.concatenate([self._spell(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

    def _spell(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        data = np.frombuffer(b"".join(PAD + (w if w == END else w + b" ") for w in words), np.uint8).astype(np.int64)
        sizes = np.array([len(PAD) + (1 if w == END else len(w) + 1) for w in words])
        gram = np.zeros(len(data) - DEPTH, np.int64)
        for i in range(DEPTH + 1):
            gram = (gram << np.int64(8)) | data[i : i + len(gram)]
        within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        distinct, inverse = np.unique(gram, return_inverse=True)
        logs = np.where(within[DEPTH:] >= len(PAD), self.gram_logs(distinct)[inverse], 0.0)
        total = np.concatenate([[0.0], np.cumsum(np.concatenate([np.zeros(DEPTH), logs]))])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


def gram_counts(docs: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """(gram, n) over the whole texts of ``docs``, combined in each task before the shuffle. Written and reread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_n, size = [], [], 0

        def merged():
            g, n = np.concatenate(held_g), np.concatenate(held_n)
            held_g.clear()
            held_n.clear()
            order = np.argsort(g, kind="stable")  # sorted runs: they are merged
            g, n = g[order], n[order]
            first = np.flatnonzero(np.diff(g, prepend=~g[:1]))
            return g[first], np.add.reduceat(n, first)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                flat = [grams(space_words(t)) for t in batch.column("text").slice(at, 500).to_pylist()]
                g, n = np.unique(np.concatenate(flat), return_counts=True)
                held_g.append(g)
                held_n.append(n)
                size += len(g)
                if size > 2 * limit:
                    g, n = merged()
                    if len(g) > limit:
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["gram", "n"])
                        g, n = g[:0], n[:0]
                    held_g, held_n, size = [g], [n], len(g)
        if size:
            g, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["gram", "n"])

    return save(docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")


def train(docs: DataFrame, divergence: float = DIVERGENCE) -> SuffixTree:
    """Counts all of ``docs`` and keeps the states. Without documents the tree is the uniform root."""
    counted = gram_counts(docs)
    total = counted.agg(F.sum("n")).first()[0] or 0
    one = counted.groupBy(F.col("gram").bitwiseAND(F.lit(255)).alias("s")).agg(F.sum("n").alias("n")).toPandas()
    root = np.full(256, 0.5)
    root[one["s"].to_numpy(np.int64)] += one["n"].to_numpy(float)
    root /= root.sum()
    tables = []
    for n in range(1, DEPTH + 1):
        pair = F.col("gram").bitwiseAND(F.lit(int(MASKS[n + 1])))
        pairs = counted.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n"))
        states = counted.groupBy(F.shiftright(pair, 8).alias("state")).agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(max(2.0, P_MIN * total)))
        states = states.toPandas().sort_values("state")
        pairs = pairs.where(F.col("n") >= F.lit(max(1.0, P_PAIR * total))).toPandas().sort_values("pair")
        tables.append((states["state"].to_numpy(np.int64), states["n"].to_numpy(float), pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(float)))
    return grow(tables, root, total, divergence)


def grow(tables: list[tuple], root: np.ndarray, total: int, divergence: float) -> SuffixTree:
    """Smooths level by level towards the suffix, tests the divergence, and keeps what passes and its suffixes."""
    empty = np.zeros(0, np.int64)
    tree = SuffixTree([empty], [empty.astype(float)], [empty], [empty.astype(float)], np.log10(root))
    passed: list[np.ndarray] = [empty]
    for n, (states, size, pairs, count) in enumerate(tables, 1):
        if len(states):
            at = np.minimum(np.searchsorted(states, pairs >> np.int64(8)), len(states) - 1)
            some = states[at] == pairs >> np.int64(8)
        else:
            at, some = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        pairs, count, at = pairs[some], count[some], at[some]
        kept, kinds = np.bincount(at, count, len(states)), np.bincount(at, minlength=len(states))
        spare = size - kept + np.maximum(kinds, 1)  # what is given to the suffix: dropped counts and one for each symbol
        below = 10 ** tree.gram_logs(pairs)
        p = (count + spare[at] * below) / (size + np.maximum(kinds, 1))[at]
        weight = spare / (size + np.maximum(kinds, 1))
        kl = np.bincount(at, p * np.log(np.maximum(p, 1e-300) / below), len(states))
        passed.append((kl >= divergence) & (size * kl >= np.log(max(total, 2))))
        tree.states.append(states)
        tree.weights.append(np.log10(weight))
        tree.pairs.append(pairs)
        tree.logs.append(np.log10(p))
    for _ in range(len(tables), DEPTH):
        for part in (tree.states, tree.weights, tree.pairs, tree.logs):
            part.append(part[0])
        passed.append(empty)
    for n in range(DEPTH, 0, -1):
        keep = passed[n].astype(bool)
        if n < DEPTH and len(tree.states[n + 1]):
            keep = keep | np.isin(tree.states[n], tree.states[n + 1] & MASKS[n])
        tree.states[n], tree.weights[n] = tree.states[n][keep], tree.weights[n][keep]
        with_state = np.isin(tree.pairs[n] >> np.int64(8), tree.states[n])
        tree.pairs[n], tree.logs[n] = tree.pairs[n][with_state], tree.logs[n][with_state]
    return tree


BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("held_out", T.ArrayType(T.BooleanType())), T.StructField("n_train", T.LongType()), T.StructField("n_keys", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("sizes", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("spelling", T.BinaryType()), T.StructField("ids", T.BinaryType()),
])
ASKED = T.StructType([T.StructField(n, T.LongType()) for n in ("bucket", "block", "at")] + [T.StructField(n, T.BinaryType()) for n in ("keys", "train")])
GAINED = T.StructType([*ASKED.fields[:4], T.StructField("gains", T.BinaryType()), T.StructField("counts", T.BinaryType())])
PASSED = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("passed", T.BinaryType())])
ANSWER = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("counts", T.BinaryType()), T.StructField("kinds", T.LongType())])
RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])
#: Tokens and documents of a block (one document at least), and keys of a bucket of requests.
BLOCK_TOKENS, BLOCK_DOCS, BUCKET_KEYS = 1_000_000, 10_000, 1_000_000


def pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys by their gaps: the low six bytes as they are, the two high ones, mostly 0, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return gaps[:, :6].tobytes() + pack(gaps[:, 6:])


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    gaps = np.empty((n, 8), np.uint8)
    gaps[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(n, 6)
    gaps[:, 6:] = unpack(data[6 * n :], np.uint8).reshape(n, 2)
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)


def rows_of(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema)], names=schema.names)


class Keys:
    """The keys of a block: its distinct words (even hashes) and pairs of neighbouring words (odd ones), sorted together.

    By token: ``pair``, ``word`` and ``before`` (the word before it) are places in ``keys``; a document's first token has
    ``START`` before it, which is a key of the block as well, with the block's training documents as its count.
    """

    def __init__(self, words: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        first = np.cumsum(sizes) - sizes
        code = words[ids]
        before = np.concatenate([[START], code[:-1]]) if len(code) else code
        before[first] = START
        pairs, pair = np.unique(mix(before * ODD + code) | np.uint64(1), return_inverse=True)
        every = np.concatenate([words, pairs, [START]])
        order = np.argsort(every, kind="stable")
        self.keys, place = every[order], np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        self.first, self.start = first, place[-1]
        self.word, self.pair = place[ids], place[len(words) + pair]
        self.before = np.concatenate([[self.start], self.word[:-1]])
        self.before[first] = self.start

    def train(self, held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        trains = np.repeat(~held, sizes)
        out = np.bincount(self.word[trains], minlength=len(self.keys)) + np.bincount(self.pair[trains], minlength=len(self.keys))
        out[self.start] += (~held).sum()
        return out.astype(np.int32)

    def contexts(self, c: np.ndarray) -> np.ndarray:
        """The places of words with a word after them that the corpus, with counts ``c``, has twice. One that it has once
        gains at most ln((1 + 3 P) / (4 P)) with P >= 1 / (2 N + 1), which is under ln(N): it can't pass the test."""
        return np.flatnonzero((np.bincount(self.before, minlength=len(self.keys)) > 0) & (c > 1))


def dealt(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of ascending keys that belong to one bucket of the hash space."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(of, prepend=~of[:1]))
    return list(zip(of[first].tolist(), first.tolist(), np.append(first[1:], len(keys)).tolist(), strict=True))


def blocks(docs: DataFrame, tree: SuffixTree) -> DataFrame:
    """Rows of up to ``BLOCK_TOKENS`` tokens of whole documents: their ids and sizes, the distinct words (sorted hashes) with
    their spellings, and the tokens as places among them. Written once, so random block ids are safe."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def block(doc_ids: list, held: list, texts: list[list[bytes]]) -> tuple:
        flat = [w for t in texts for w in (*t, END)]
        sizes = np.array([len(t) + 1 for t in texts])
        words, first, ids = np.unique(hashes(flat) & ~np.uint64(1), return_index=True, return_inverse=True)
        spelling = shared.value.spell([flat[i] for i in first.tolist()])
        n = len(Keys(words, ids, sizes).keys)
        return uuid.uuid4().int >> 65, doc_ids, held, int(sizes[~np.array(held, bool)].sum()), n, len(words), pack(sizes), pack_sorted(words), pack(np.rint(spelling * STEPS).clip(-32768, 0).astype(np.int16)), pack(ids.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                words = space_words(text)
                if texts and (size + len(words) > BLOCK_TOKENS or len(texts) == BLOCK_DOCS):
                    yield rows_of(BLOCK, [block(ids, held, texts)])
                    ids, held, texts, size = [], [], [], 0
                ids.append(doc_id)
                held.append(out)
                texts.append(words)
                size += len(words) + 1
        if texts:
            yield rows_of(BLOCK, [block(ids, held, texts)])

    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(5) == 1).alias("held_out"), "text")
    # dealt by block once, as it is written, so that the answers join it without another shuffle of it
    return save_dealt(mine.mapInArrow(run, BLOCK), "blocks", "block")


def opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(block, doc_ids, held_out, sizes, spelling, keys, number of words) of the rows of a batch of blocks."""
    for row in batch.to_pylist():
        spelling = unpack(row["spelling"], np.int16) / STEPS
        sizes, ids = unpack(row["sizes"], np.int64), unpack(row["ids"], np.int32)
        yield row, np.array(row["held_out"], bool), sizes, spelling, ids, Keys(unpack_sorted(row["words"], len(spelling)), ids, sizes)


def corpus_counts(made: DataFrame) -> DataFrame:
    """(block, parts, kinds): the corpus counts of each block's keys, in the keys' order, and how many known words the block
    is the first to name. Written once, dealt like the blocks.

    Requests go to buckets of the hash space, as many as keep a bucket near ``BUCKET_KEYS``, and back to their block, both
    as packed arrays. A key has one request a block, however often the block's documents use it.
    """
    buckets = math.ceil((made.agg(F.sum("n_keys")).first()[0] or 0) / BUCKET_KEYS) or 1
    start = np.uint64(START)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, held, sizes, _, _, own in opened(batch):
                keys, train = own.keys, own.train(held, sizes)
                rows = [(of, row["block"], a, pack_sorted(keys[a:b]), pack(train[a:b])) for of, a, b in dealt(keys, buckets)]
                for at in range(0, len(rows), 200):
                    yield rows_of(ASKED, rows[at : at + 200])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                keys = np.concatenate([x[2] for x in held])
                _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                total = np.bincount(inverse, np.concatenate([x[3] for x in held])).astype(np.int64)
                named = np.zeros(len(keys), bool)
                named[first] = total > 0
                named &= (keys & np.uint64(1) == 0) & (keys != start)
                ends = np.cumsum([len(x[2]) for x in held])
                for at in range(0, len(held), 200):
                    part = zip(held[at : at + 200], ends[at : at + 200].tolist(), strict=True)
                    yield rows_of(ANSWER, [(x[0], x[1], pack(total[inverse[e - len(x[2]) : e]]), int(named[e - len(x[2]) : e].sum())) for x, e in part])
                held.clear()

        for batch in batches:
            for of, block, at, keys, train in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "at", "keys", "train")), strict=True):
                if of != bucket:
                    yield from close()
                    bucket = of
                train = unpack(train, np.int32)
                held.append((block, at, unpack_sorted(keys, len(train)), train))
        yield from close()

    asked = made.mapInArrow(deal, ASKED)
    answers = asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(answer, ANSWER)
    return save_dealt(gathered(answers, "counts", F.sum("kinds").alias("kinds")), "answers", "block")


def gathered(answers: DataFrame, column: str, *more) -> DataFrame:
    """(block, parts) and ``more``: each block's ``column`` in the order of ``at``."""
    made = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", column))).alias("parts"), *more)
    return made.withColumn("parts", F.transform("parts", lambda x: x[column]))


def word_logs(own: Keys, c: np.ndarray, spelled: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """By token: the root's probability of the word, and that of the word before it as a state."""
    root = (c[own.word] + (v + 1.0) * spelled) / (n + v + 1.0)
    back = KAPPA + c[own.before]
    return root, (c[own.pair] + back * root) / (c[own.before] + back)


def counted(parts: list[bytes] | None, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for x in parts or [])])


def word_states(made: DataFrame, answers: DataFrame, n: int, v: int, divergence: float) -> DataFrame:
    """(block, passed): for each of the block's contexts, in the keys' order, whether the corpus's words after it pass the
    divergence test. A block that has no context has no row.

    A training token gains ln(P(w | u) / P(w)). Each block sends the sums of its tokens by context, packed, to the
    context's bucket, which adds them up, and gets one flag a context back: one key a block, however often it is used.
    """
    buckets = math.ceil((made.agg(F.sum("n_words")).first()[0] or 0) / BUCKET_KEYS) or 1
    least = math.log(max(n, 2))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, held, sizes, spelling, ids, own in opened(batch):
                c = counted(row["parts"], np.int64)
                root, after = word_logs(own, c.astype(float), 10.0 ** np.maximum(spelling, -300.0)[ids], n, v)
                gain = np.where(np.repeat(~held, sizes), np.rint(NAT * np.log(after / root)), 0.0)
                asked = own.contexts(c)
                keys, gains, counts = own.keys[asked], np.bincount(own.before, gain, len(c))[asked].astype(np.int64), c[asked]
                rows = [(of, row["block"], a, pack_sorted(keys[a:b]), pack(gains[a:b]), pack(counts[a:b])) for of, a, b in dealt(keys, buckets)]
                for at in range(0, len(rows), 200):
                    yield rows_of(GAINED, rows[at : at + 200])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                _, inverse = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
                total = np.bincount(inverse, np.concatenate([x[3] for x in held]))[inverse] / NAT
                passed = ((total >= least) & (total >= divergence * np.concatenate([x[4] for x in held]))).astype(np.uint8)
                ends = np.cumsum([len(x[2]) for x in held])
                for at in range(0, len(held), 200):
                    part = zip(held[at : at + 200], ends[at : at + 200].tolist(), strict=True)
                    yield rows_of(PASSED, [(x[0], x[1], pack(passed[e - len(x[2]) : e])) for x, e in part])
                held.clear()

        for batch in batches:
            for of, block, at, keys, gains, counts in zip(*(batch.column(c).to_pylist() for c in GAINED.names), strict=True):
                if of != bucket:
                    yield from close()
                    bucket = of
                gains = unpack(gains, np.int64)
                held.append((block, at, unpack_sorted(keys, len(gains)), gains, unpack(counts, np.int64)))
        yield from close()

    asked = made.join(answers, "block").mapInArrow(deal, GAINED)
    passed = save(asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(test, PASSED), "states")
    return gathered(passed, "passed").withColumnRenamed("parts", "passed")


def score_texts(docs: DataFrame, tree: SuffixTree, divergence: float | None = None) -> DataFrame:
    """RESULT rows of every document of ``docs``, by the tree and by the corpus counts of the rows that are not held out.

    Words are states if they pass the test with ``divergence``; without one every word of the corpus is a state.

    Neither the vocabulary nor its counts are broadcast or collected. Words are compared by 64-bit hashes. Null and empty
    texts are one end; a null id counts as the empty text for the fold; rows that repeat an id or a text each count and
    give a row; an empty table gives none; other columns are left out, whatever their names.
    """
    made = blocks(docs, tree)
    answers = corpus_counts(made)
    n, v = made.agg(F.sum("n_train")).first()[0] or 0, answers.agg(F.sum("kinds")).first()[0] or 0
    norm = n + 0.5 * (v + 1)
    joined = made.join(answers, "block")
    if divergence is not None:
        joined = joined.join(word_states(made, answers, n, v, divergence), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, held, sizes, spelling, ids, own in opened(batch):
                c = counted(row["parts"], np.int64)
                root, after = word_logs(own, c.astype(float), 10.0 ** np.maximum(spelling, -300.0)[ids], n, v)
                if divergence is not None:
                    states = np.zeros(len(c), bool)
                    states[own.contexts(c)] = counted(row["passed"], np.uint8) > 0
                    after = np.where(states[own.before], after, root)
                word = c[own.word]
                sums = [np.add.reduceat(x, own.first) for x in (word > 0, np.log10((word + 0.5) / norm), np.log10(after))]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(held), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(sizes), n, np.int64)), *map(pa.array, sums[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=RESULT.names)

    return joined.mapInArrow(run, RESULT)


def contract(docs: DataFrame) -> DataFrame:
    """A row a document; the odd cases are those of :func:`score_texts`."""
    return score_texts(docs, train(docs.where(fold(5) != 1)), DIVERGENCE)
