"""Benchmark decontamination by a positional inverted index: exact phrases and proximity matches of test items.

The index holds every token of the training documents and is partitioned by document: a segment is a run of whole
documents with, per term, its sorted positions. It is built once and serves any number of searches. A position never
spans two documents. A search looks up the rarest term of each phrase and intersects the offset-adjusted lists of the
others, rarest first. Terms are 64-bit hashes of words.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.store import save
from lattica.llm.text import alnum_words, hashes

SEGMENT = T.StructType([
    T.StructField("segment", T.StringType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("starts", T.BinaryType()), T.StructField("n_words", T.BinaryType()),
    T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("positions", T.BinaryType()),
])
RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")] + [T.StructField("item_ids", T.ArrayType(T.LongType()))]
)
PROXIMITY = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "query", "position")])
GAP = 64


def pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def items_of(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks of at most ``block`` words (one item at least), streamed to the driver a partition at a time.

    Rows with a null id or without words cannot match; rows of one id are one item with several texts.
    """
    part, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = alnum_words(row[1])
        if words:
            if part and size + len(words) > block:
                yield part
                part, size = [], 0
            part.append((row[0], words))
            size += len(words)
    if part:
        yield part


def build_index(docs: DataFrame, segment_words: int = 1_000_000) -> DataFrame:
    """Segments of postings of every word of ``docs``: whole documents, every position, nothing shuffled.

    A document longer than ``segment_words`` is a segment by itself. Null and empty texts have a place without words.
    Written to the shared folder and reread; ``segment`` names a row of the written table.
    """

    def segment(ids: list, parts: list[np.ndarray]) -> tuple:
        n = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate([[0], np.cumsum(n + GAP)[:-1]]).astype(np.int64)
        flat = np.concatenate(parts)
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(flat))
        order = np.argsort(flat, kind="stable")
        terms, counts = np.unique(flat, return_counts=True)
        gaps = np.diff(at[order], prepend=0)
        return uuid.uuid4().hex, ids, pack(starts), pack(n), pack(terms), pack(counts.astype(np.int64)), pack(gaps.astype(np.int64) if np.abs(gaps).max(initial=0) >= 2**31 else gaps.astype(np.int32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = hashes(alnum_words(text if isinstance(text, str) else None))
                if parts and size + len(words) > segment_words:
                    yield pd.DataFrame([segment(ids, parts)], columns=SEGMENT.names)
                    ids, parts, size = [], [], 0
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                parts.append(words)
                size += len(words)
        if parts:
            yield pd.DataFrame([segment(ids, parts)], columns=SEGMENT.names)

    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SEGMENT), "postings")


def places(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` is in the sorted ``terms``, and whether it is there."""
    if not len(terms):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return at, terms[at] == wanted


class Segment:
    """One segment's postings in memory, of the terms of a sorted ``vocabulary``; terms are numbers in it."""

    def __init__(self, row, vocabulary: np.ndarray) -> None:
        self.ids = row.doc_ids
        self.starts, self.n = unpack(row.starts, np.int64), unpack(row.n_words, np.int64)
        counts = unpack(row.counts, np.int64)
        at, self.present = places(unpack(row.terms, np.uint64), vocabulary)
        data = zlib.decompress(row.positions)
        gaps = np.frombuffer(data, np.int32 if len(data) == 4 * int(counts.sum()) else np.int64)
        self.flat = np.cumsum(gaps, dtype=np.int64)
        ends = np.cumsum(counts)
        self.end = ends[at] if len(ends) else at
        self.begin = self.end - counts[at] if len(ends) else at

    def positions(self, term: int) -> np.ndarray:
        return self.flat[self.begin[term] : self.end[term]] if self.present[term] else self.flat[:0]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def phrase(self, terms: list[int], rarity: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase: the rarest term's list, then the others', each shifted by its offset."""
        order = sorted(range(len(terms)), key=lambda i: (rarity[terms[i]], i))
        starts = self.positions(terms[order[0]]) - order[0]
        for i in order[1:]:
            if not len(starts):
                break
            starts = starts[places(self.positions(terms[i]), starts + i)[1]]
        return starts

    def near(self, terms: list[int], rarity: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term that have every other term within ``span`` words in the same document."""
        order = sorted(set(terms), key=lambda t: (rarity[t], t))
        here = self.positions(order[0])
        for t in order[1:]:
            if not len(here):
                break
            other = self.positions(t)
            if not len(other):
                return other
            after = np.searchsorted(other, here)
            best = np.minimum(
                np.where(after < len(other), np.abs(other[np.minimum(after, len(other) - 1)] - here), 1 << 60),
                np.where(after > 0, np.abs(here - other[np.maximum(after - 1, 0)]), 1 << 60),
            )
            here = here[best <= span]
        return here


def rarity_of(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Corpus frequency of each vocabulary term, summed over all segments; its length is the vocabulary's."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for t, c in zip(batch["terms"], batch["counts"], strict=True):
                at, here = places(unpack(t, np.uint64), shared.value)
                total[here] += unpack(c, np.int64)[at[here]]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    got = index.select("terms", "counts").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[got["term"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted vocabulary (hashes) of the texts, and each text as numbers in it."""
    codes = [hashes(t) for t in texts]
    vocabulary = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
    return vocabulary, [np.searchsorted(vocabulary, c) for c in codes]


def match_phrases(docs: DataFrame, benchmark: DataFrame, window: int = 8, block: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, item_ids (sorted, distinct).

    The index is built once. Items are searched in blocks of at most ``block`` words, so what is broadcast is bounded at
    any size of the benchmark; a document's blocks meet by its place in the index, whatever its id. Null and empty texts
    have no words and no hits; null items and items without words match nothing; an empty benchmark hits nothing; rows
    that repeat an id or a text each give a row; other columns are left out, whatever their names.
    """
    parts, index = [], None
    for items in items_of(benchmark, block):
        index = build_index(docs) if index is None else index
        vocabulary, codes = numbered([words for _, words in items])
        wanted: dict[tuple[int, ...], set[int]] = {}
        for (item, _), code in zip(items, codes, strict=True):
            code = code.tolist()
            for i in range(max(1, len(code) - window + 1)):
                wanted.setdefault(tuple(code[i : i + window]), set()).add(item)
        phrases = [(list(k), sorted(v)) for k, v in wanted.items()]
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, rarity_of(index, vocabulary), phrases, window))
        kind = "segment string, at long, doc_id long, n_words long, hits array<struct<a:long,b:long>>, item_ids array<long>"
        parts.append(index.mapInPandas(lambda batches, shared=shared: search(batches, *shared.value), kind))
    if not parts:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(plain, RESULT)
    both = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            both = both.unionByName(p)
        items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
        both = both.groupBy("segment", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), items.alias("item_ids"))
    return both.select("doc_id", "n_words", covered("hits").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def covered(column: str):
    """Words in the union of [a, b) intervals."""
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["at"], x["a"]))).alias("n"), F.greatest(s["at"], x["b"]).alias("at"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(F.array_sort(F.col(column)), zero, step, lambda s: s["n"])


def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(None if pd.isna(d) else int(d), len(alnum_words(t if isinstance(t, str) else None)), 0, 0, []) for d, t in zip(batch["doc_id"], batch["text"], strict=True)]
        yield pd.DataFrame(rows, columns=RESULT.names).astype({"doc_id": "Int64"})


def search(batches: Iterator[pd.DataFrame], vocabulary: np.ndarray, rarity: np.ndarray, phrases: list[tuple[list[int], list[int]]], window: int) -> Iterator[pd.DataFrame]:
    # a phrase with a term that the corpus, or a segment, lacks occurs nowhere there
    code = np.array([p + p[-1:] * (window - len(p)) for p, _ in phrases]).reshape(-1, window)
    possible = np.flatnonzero((rarity[code] > 0).all(1))
    for batch in batches:
        for row in batch.itertuples(index=False):
            seg = Segment(row, vocabulary)
            m = len(seg.ids)
            items: list[set[int]] = [set() for _ in range(m)]
            spans: list[list[tuple[int, int]]] = [[] for _ in range(m)]
            for k in possible[seg.present[code[possible]].all(1)].tolist():
                phrase, of = phrases[k]
                for at, d in zip((s := seg.phrase(phrase, rarity)).tolist(), seg.document(s).tolist()):
                    items[d].update(of)
                    a = at - int(seg.starts[d])
                    spans[d].append((a, a + len(phrase)))
            hits = []
            for found in spans:
                merged: list[list[int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                hits.append([{"a": a, "b": b} for a, b in merged])
            for at in range(0, m, 10_000):
                cut = slice(at, at + 10_000)
                yield pd.DataFrame({
                    "segment": row.segment, "at": np.arange(m)[cut], "doc_id": pd.array([None if x is None or pd.isna(x) else int(x) for x in seg.ids[cut]], "Int64"),
                    "n_words": seg.n[cut], "hits": hits[cut], "item_ids": [sorted(x) for x in items[cut]],
                })


def match_proximity(docs: DataFrame, queries: dict[int, str], span: int = 16) -> DataFrame:
    """(doc_id, query, position): places of a query's rarest term with every other of its terms within ``span`` words, in any order.

    Queries without words match nothing. The query set is the caller's and is broadcast whole.
    """
    words = {q: w for q, t in queries.items() if (w := alnum_words(t))}
    vocabulary, codes = numbered(list(words.values()))
    index = build_index(docs)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, rarity_of(index, vocabulary), [(q, c.tolist()) for q, c in zip(words, codes, strict=True)]))

    def run(batches):
        vocabulary, rarity, wanted = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                seg = Segment(row, vocabulary)
                rows = []
                for q, terms in wanted:
                    at = seg.near(terms, rarity, span)
                    d = seg.document(at)
                    rows += [(seg.ids[k], q, p - int(seg.starts[k])) for k, p in zip(d.tolist(), at.tolist())]
                yield pd.DataFrame(rows, columns=PROXIMITY.names)

    return index.mapInPandas(run, PROXIMITY)


def contract(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of :func:`match_phrases`, a row a document; its odd cases hold here as well."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return match_phrases(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2) -> DataFrame:
    """``docs`` without the rows of which a whole ``window`` of words lies in benchmark text, or which hold (shorter) items
    of ``least_items`` ids or more; all columns stay. Each row is decided by its own text: rows are told apart by a hash
    of id and text, so null ids and repeated ids share nothing but equal texts.
    """
    row = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    found = match_phrases(docs.select(row.alias("doc_id"), "text"), benchmark, window)
    bad = found.where((F.col("n_hit") >= window) | (F.col("n_items") >= least_items)).select(F.col("doc_id").alias("bad_row")).distinct()
    return docs.join(bad, row == bad["bad_row"], "left_anti")


__all__ = ["build_index", "contract", "drop_contaminated", "match_phrases", "match_proximity"]
