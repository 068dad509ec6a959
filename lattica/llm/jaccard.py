"""Exact Jaccard join of shingle sets in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion.

Jaccard distance is a metric, and so is the size of the symmetric difference, restricted to any part of the universe of
shingles; counts of shingles by hash cell embed the second one in L1 without enlarging it. Sets of different texts lie
almost all at Jaccard distance 1, so pivots drawn from all documents would separate nothing and every window would hold
every document. A first step that is no pivot method therefore blocks the table: the universe is dealt into parts by
hash, and as linked sets differ in a bounded number of shingles, they must agree on one of the parts that each of them
picks (``region_keys``). The metric join works inside these blocks (``close_pairs``): pivots are members, every member
lies in the Voronoi region of its nearest pivot in the L1 metric and is replicated to each other region that the triangle
inequality leaves open, and regions join recursively with pivots of their own until they are small or no pivot separates
them; then their pairs are taken. Pairs within reach of a link are verified by their whole sets, first those with the
most central partner, then those that no chain of links joins yet, so groups of copies cost no pairs among themselves.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.graph import components
from lattica.llm.store import annotate, fresh, save
from lattica.llm.text import hashes, mix, space_words, windows

#: Members of a block that one task holds, in the order of their size; those of other slabs within the size window are its guests.
SLAB = 2048
#: Members of a region that are compared without further pivots, and pivots of a larger one.
LEAF, PIVOTS = 64, 4
#: Cells of a set's sketch: counts of its shingles by hash.
CELLS = 128
#: Keys over which the rows of one group of equal sets are dealt.
SALTS = 16


def most_apart(total, percent: int):
    """The largest symmetric difference of linked sets whose sizes add up to ``total``."""
    return total * (100 - percent) // (100 + percent)


def reach(n: int, percent: int) -> int:
    """The largest symmetric difference of a set of ``n`` and one linked with it."""
    return most_apart(n + n * 100 // percent, percent)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(windows(hashes(space_words(text)), k))


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, as two signed longs."""
    size = np.uint64(len(h))
    with np.errstate(over="ignore"):
        a = mix(np.array([mix(h).sum(dtype=np.uint64) + size]))[0]
        b = mix(np.array([mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) ^ size]))[0]
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(h: np.ndarray) -> bytes:
    """How many shingles of the set fall into each of ``CELLS`` hash cells. The cells' differences of two sets add up to at
    most their symmetric difference."""
    cells = np.bincount((h >> np.uint64(20)).astype(np.int64) % CELLS, minlength=CELLS)
    return np.minimum(cells, np.iinfo(np.uint16).max).astype(np.uint16).tobytes()


def region_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """The blocks of a sorted set. Linked sets share one.

    Sizes fall into octaves; the smaller of two partners joins the octave of the larger one as well. An octave deals the
    universe into a fixed number of parts. Sets that differ in at most D = ``reach`` shingles differ in at most D parts,
    so of the parts that a set holds all but D agree with a partner's. Both pick their first D + 1 parts in an order that
    only content decides (fullest first): the first part on which they agree is picked by both. A set with no more than D
    parts picks all, and shingles (its D + 1 least) as well, for partners that are as few-parted.
    """
    n = len(h)
    octave, apart = n.bit_length() - 1, reach(n, percent)
    out = []
    for level in (octave, octave + 1):
        if level > octave and percent << level > n * 100:
            break
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
        parts = max(1, 12 * reach(1 << level, percent) // 5)
        of = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # follows the order of h: a part is a slice
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        key = mix(mix(np.add.reduceat(mix(h + np.uint64(0x632BE59BD9B4E019)), first) + of[first]) ^ seed)
        if len(key) > apart + 1:
            key = key[np.lexsort((key, -np.diff(first, append=n)))[: apart + 1]]
        elif len(key) <= apart:
            out.append(mix(mix(h[: apart + 1] + np.uint64(0x5851F42D4C957F2D)) ^ seed))
        out.append(key)
    return np.unique(np.concatenate(out))


def regions(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(region, key) of every set that can link with a different one. Copies met again in a task are left out."""
    least = -(-percent // (100 - percent))  # smaller sets link with equal ones only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found, keys = [], []
                for text in batch.column("text").slice(at, 500).to_pylist():
                    h = shingle_set(text, k)
                    if len(h) < least or (key := set_key(h)) in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    found.append(region_keys(h, percent))
                    keys.append(key[0])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), [len(x) for x in found]))], names=["region", "key"])

    return docs.select("text").mapInArrow(run, "region long, key long")


def shared_regions(rows: DataFrame) -> DataFrame:
    """(region, key) of the blocks with two sets or more, one of each group of blocks with the same members.

    One shuffle by block; a window of its own rows, which Spark spills, holds no block in memory. Equal keys of different
    sets (64 bits) lose nothing: the key's sets all take its place afterwards.
    """
    rows = rows.repartition("region").dropDuplicates(["region", "key"])
    w = Window.partitionBy("region")
    same = F.xxhash64(F.sum(F.xxhash64("key").cast("decimal(20,0)")).over(w).cast("string"), F.min("key").over(w), F.max("key").over(w), F.count("*").over(w))
    held = rows.select("key", same.alias("members"), (F.min("key").over(w) != F.max("key").over(w)).alias("shared")).where("shared")
    return held.select(F.col("members").alias("region"), "key").distinct()


def place(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(region, slab, guest, rep, n, rank, sketch): each member in its own slab, and as a guest in the later slabs of its size window.

    Sizes are distances from the empty set, so the window is the triangle inequality's. ``rank`` is lower for members of
    more blocks, which are the more central ones.
    """
    degree = held.groupBy("key").agg(F.count("*").alias("degree"))
    rows = held.join(sets.join(degree, "key"), "key").select("region", "rep", "n", (-F.col("degree")).alias("rank"), "sketch")
    at = F.row_number().over(Window.partitionBy("region").orderBy("n", "rep"))
    placed = save(rows.withColumn("slab", F.floor((at - 1) / SLAB)), "placed")
    starts = placed.groupBy("region", F.col("slab").alias("to")).agg(F.min("n").alias("start")).where("to > 0")
    guests = placed.join(starts, "region").where((F.col("to") > F.col("slab")) & (F.col("start") * percent <= F.col("n") * 100))
    fields = ("rep", "n", "rank", "sketch")
    return placed.select("region", "slab", F.lit(False).alias("guest"), *fields).unionByName(guests.select("region", F.col("to").alias("slab"), F.lit(True).alias("guest"), *fields))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distances of the rows of ``a`` and ``b``."""
    if len(a) * len(b) <= 4096:
        return np.abs(a[:, None, :] - b[None, :, :]).sum(2, dtype=np.int32)
    out = np.zeros((len(a), len(b)), np.int32)
    for c in range(a.shape[1]):
        out += np.abs(a[:, None, c] - b[None, :, c])
    return out


def close_pairs(s: np.ndarray, n: np.ndarray, percent: int, home: np.ndarray, guests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, home or guest) of sets near enough to link, each once.

    A region that is not small takes pivots spread over its members' sizes. A member x lies with its nearest pivot p; if
    a partner y, at most r away, lies with q, then d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2r: so y is a guest
    at every p with d(y, p) - d(y, q) <= 2r. Of two homes the later region's member is the guest. The regions then join
    in the same way; one that keeps nearly all is compared as it is.
    """
    total = len(home) + len(guests)
    if total > LEAF and len(home) > PIVOTS:
        both = np.concatenate([home, guests])
        pivots = home[np.argsort(n[home], kind="stable")[np.linspace(0, len(home) - 1, PIVOTS).astype(int)]]
        d = apart(s[both], s[pivots])
        cell, least = d.argmin(1), d.min(1)
        radius = most_apart(n[both] + n[both] * 100 // percent, percent)
        cells = []
        for p in range(PIVOTS):
            window = d[:, p] - least <= 2 * radius
            inside = np.flatnonzero(cell[: len(home)] == p)
            cells.append((both[inside], np.concatenate([home[window[: len(home)] & (cell[: len(home)] > p)], guests[window[len(home) :]]])))
        if max(len(x) + len(y) for x, y in cells) <= 0.9 * total:
            for x, y in cells:
                if len(x):
                    yield from close_pairs(s, n, percent, x, y)
            return
    for at in range(0, len(home), 1024):
        here = home[at : at + 1024]
        for to in (home[at:], guests):
            for start in range(0, len(to), 1024):
                other = to[start : start + 1024]
                near = apart(s[here], s[other]) <= most_apart(n[here][:, None] + n[other][None, :], percent)
                i, j = np.nonzero(near)
                x, y = here[i], other[j]
                keep = x != y if to is guests else start + j > i
                yield x[keep], y[keep]


def by_slab(rows: DataFrame, extra: tuple[str, ...], percent: int, make) -> DataFrame:
    """Pairs (a, b) that ``make`` (the members' columns, pairs of their indices) returns for each slab with its guests. A
    task holds one slab and one block of guests."""
    rows = rows.repartition("region", "slab").sortWithinPartitions("region", "slab", "guest")
    names = ("rep", "n", "rank", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, home, guests, out, seen = None, [], [], [], set()

        def close(whole: bool) -> None:
            if len(home) and (guests or whole) and len(home) + len(guests) > 1:
                rows = home + guests
                s = np.stack([x[-1] for x in rows])
                cols = {name: np.array([x[i] for x in rows], np.int64) for i, name in enumerate(names)}
                index = np.arange(len(rows))
                blocks = close_pairs(s, cols["n"], percent, index[: len(home)], index[len(home) :])
                i, j = map(np.concatenate, zip(*blocks, strict=True))
                if guests and not whole:
                    keep = j >= len(home)  # the members among themselves come with the last block of guests
                    i, j = i[keep], j[keep]
                for pair in make(cols, i, j):
                    if pair not in seen:
                        seen.add(pair)
                        out.append(pair)
            guests.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out.clear()
            if len(seen) > 500_000:
                seen.clear()
            return made

        for batch in batches:
            cells = [np.frombuffer(x, np.uint16).astype(np.int16 if max(x[1::2]) < 64 else np.int32) for x in batch.column("sketch").to_pylist()]
            for region, slab, guest, *rest in zip(*(batch.column(c).to_pylist() for c in ("region", "slab", "guest", *names)), cells, strict=True):
                if (region, slab) != group:
                    close(True)
                    group, home = (region, slab), []
                elif len(guests) == SLAB:
                    close(False)
                (guests if guest else home).append(rest)
            yield flush()
        close(True)
        yield flush()

    return rows.select("region", "slab", "guest", *names, "sketch").mapInArrow(run, "a long, b long")


def nearest_central(cols: dict, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each member with a near partner its most central one, if that is more central than itself; else itself twice."""
    order = np.lexsort((cols["rep"], cols["rank"]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    best = np.full(len(order), len(order))
    low, high = np.minimum(place[i], place[j]), np.maximum(place[i], place[j])
    np.minimum.at(best, high, low)
    np.minimum.at(best, low, low)
    rep = cols["rep"][order]
    for x in np.flatnonzero(best < len(order)).tolist():
        yield int(rep[best[x]]), int(rep[x])


def unjoined(cols: dict, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """The near pairs that carry different labels."""
    keep = cols["label"][i] != cols["label"][j]
    a, b = cols["rep"][i[keep]], cols["rep"][j[keep]]
    yield from zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)


def payloads(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, blob): the compressed words of the document of each row of ``wanted`` (rep, key, key2). Texts are shuffled by id, at every size."""
    mine = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.hint("merge"), "rep")

    def fn(texts):
        keys = [set_key(shingle_set(t, k)) for t in texts]
        return [[zlib.compress(b" ".join(space_words(t)), 1) for t in texts], [x[0] for x in keys], [x[1] for x in keys]]

    fields = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("own", T.LongType()), T.StructField("own2", T.LongType())])
    # a repeated id with another text is not the document that was chosen, and one repeated with the same text is one
    made = annotate(mine, fn, fields, ("rep", "key", "key2")).where("own = key and own2 = key2")
    return save(made.select("rep", "blob").dropDuplicates(["rep"]), "payloads")


def links(pairs: DataFrame, blobs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose whole sets link. ``b`` travels once a pair, ``a`` once."""
    pivot, member = (blobs.select(F.col("rep").alias(c), F.col("blob").alias(f"blob_{c}")) for c in "ab")
    rows = pairs.join(member, "b").join(pivot, "a").select("a", "b", "blob_a", "blob_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[int, np.ndarray] = OrderedDict()
        size = 0

        def of(rep: int, blob: pa.Scalar) -> np.ndarray:
            nonlocal size
            got = cache.get(rep)
            if got is None:
                got = cache[rep] = np.unique(windows(hashes(zlib.decompress(blob.as_py()).split()), k))
                size += len(got)
                while len(cache) > 2 and (size > 4_000_000 or len(cache) > 2048):
                    size -= len(cache.popitem(last=False)[1])
            return got

        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "blob_a", "blob_b"))
            linked = []
            for i, (ka, kb) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                s, t = of(ka, x[i]), of(kb, y[i])
                both = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(both * 100 >= (len(s) + len(t) - both) * percent)
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return save(rows.mapInArrow(run, "a long, b long"), "links")


def jaccard_labels(docs: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, label) of the representatives that link with another: the smallest one reachable.

    ``groups``: (key, key2, rep, n, sketch) of the distinct sets; ``docs`` holds only rows with an id.
    """
    held = save(shared_regions(regions(docs, k, percent)), "regions")
    placed = save(place(held, groups.select("key", "rep", "n", "sketch"), percent), "slabs")
    near = save(by_slab(placed, (), percent, nearest_central).distinct(), "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    blobs = payloads(docs, groups.select("rep", "key", "key2").join(wanted, "rep"), k)
    labels = components(links(near.where("a <> b"), blobs, k, percent))
    known = wanted.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    more = save(by_slab(placed.join(known, "rep"), ("label",), percent, unjoined).distinct(), "near")
    more = links(more, blobs, k, percent)
    return labels if more.isEmpty() else components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    A set is the distinct ``k``-word shingles of the whole lower-cased text, or with fewer words the whole sequence. Two
    rows link when 100 * intersection >= ``percent`` * union. Null and empty texts have the empty set and are their own
    component; repeated ids and copies share one. Rows with a null id link nothing: they take the component of an equal
    set, else null. Shingles are compared by 64-bit hashes and equal sets by 128 bits.
    Equal sets are one point of the space; links are found between points only, so copies cost no pairs.
    """

    def fn(texts):
        sets = [shingle_set(t, k) for t in texts]
        keys = [set_key(h) for h in sets]
        return [[len(h) for h in sets], [x[0] for x in keys], [x[1] for x in keys], [sketch(h) for h in sets]]

    fields = T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()), T.StructField("sketch", T.BinaryType())])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = save(annotate(own, fn, fields, ("doc_id",)), "sets")
    groups = sets.where("n > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    groups = save(groups, "groups")
    labels = jaccard_labels(own.where("doc_id is not null"), groups.where("rep is not null"), k, percent)
    groups = groups.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # Copies meet their group over SALTS keys; a group of one has its only member's salt.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    spread = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")))
    groups = groups.select("key", "key2", "label", F.explode(spread).alias("salt"))
    joined = sets.withColumn("salt", salt).join(groups, ["key", "key2", "salt"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def contract(docs: DataFrame) -> DataFrame:
    """Four-word shingles, similarity 0.85 or more; the odd cases are those of :func:`link_documents`. An empty table gives no
    rows; other columns are left out, whatever their names."""
    return link_documents(docs, k=4, percent=85)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the component's id.

    All columns stay. Rows without words and rows with a null id stay; of rows that repeat an id the first by its text stays.
    """
    linked = link_documents(docs, k, percent)
    gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["gone"], "left_anti")
    again = linked.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again")
    again = save(again, "again")
    if again.isEmpty():
        return kept
    rank = fresh("rank", docs.columns)
    here = docs["doc_id"].cast("long") == again["again"]
    once = kept.join(again, here, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(rank) == 1).drop(rank)
    return kept.join(again, here, "left_anti").unionByName(once)


