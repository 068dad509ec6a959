"""Caps that are gone, rows that share an id, empty tables, clashing names, and the parts of the join and the model."""

import math
import random
import time
import tracemalloc
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import decontam, jaccard, licenses, linecrf, mixing, secrets, suffixlm
from lattica.llm.text import hashes


@pytest.mark.parametrize("block", [8, 200_000])
def test_blocks_of_items_keep_rows_of_one_id_apart(spark, block):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(8 + i))) for i in range(1, 5)]
    docs = [(1, "a b " + items[0][1]), (1, items[1][1] + " c d"), (None, items[2][1]), (None, "nothing here"), (2, items[3][1] + " " + items[0][1]), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontam.match_phrases(df, spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
    want = [(d, *brute.decontaminate([(d, t)], items)[d][:3]) for d, t in docs]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got), key=key) == sorted(want, key=key)


def test_long_template_and_rows_of_one_id(spark):
    body = " ".join(f"term{i} of the" for i in range(700))
    half = licenses.TEMPLATES["MIT-notice"].split()
    rows = [(1, "x " * 50 + body + " y" * 50), (2, " ".join(body.split()[:900])), (3, " ".join(half[:10])), (3, " ".join(half[10:])), (None, "plain"), (None, licenses.TEMPLATES["ISC"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan_licenses(df, licenses.TEMPLATES | {"body": body}).collect()
    assert sorted((r.doc_id or 0, r.template) for r in found) == [(0, "ISC"), (1, "body")]


def test_license_recall_in_crowded_windows(spark):
    rng, rows = random.Random(4), []
    for i in range(40):
        parts = list(licenses.TEMPLATES.items())
        rng.shuffle(parts)
        cut = []
        for _, text in parts:
            w = text.split()
            drop = len(w) // 16  # leaves 0.8 of the shingles or more of the longer ones
            cut.append(" ".join(w[drop:] if rng.random() < 0.5 else w))
        rows.append((i, " ".join(cut)))
    sets = {n: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for n, w in ((n, brute.words2(t)) for n, t in licenses.TEMPLATES.items())}
    want = set()
    for d, t in rows:
        w = brute.words2(t)
        mine = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        want |= {(d, n) for n, s in sets.items() if len(s & mine) >= 0.8 * len(s)}
    got = {(r.doc_id, r.template) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_mixing_names_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    clash = odd.withColumn("_of", F.lit(7)).withColumn("_labelled", F.lit(8)).withColumn("rate", F.lit("r")).withColumn("copies", F.lit("c")).withColumn("w0", F.lit(1))
    out = mixing.sample_mixture(clash, labels)
    assert set(clash.columns) <= set(out.columns) and out.where("_of <> 7 or _labelled <> 8 or rate <> 'r' or copies <> 'c'").count() == 0
    assert mixing.sample_mixture(clash, labels.where(F.lit(False))).count() == odd.count()
    assert mixing.sample_mixture(clash.where(F.lit(False)), labels).count() == 0


def test_pipeline_stages_on_odd_and_empty_rows(spark, odd, tmp_path):
    tables = {
        "documents": odd.withColumn("gone", F.lit(1)).withColumn("row", F.lit(2)),
        "labels": spark.createDataFrame([(1, 1, 0), (6, 1, 0), (7, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "one two three four five six seven eight nine"), (None, "x"), (2, None)], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/full/{name}.parquet")
        df.where(F.lit(False)).write.parquet(f"{tmp_path}/none/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/full/documents.parquet"), f"{tmp_path}/full")
        assert out.columns[: len(odd.columns)] == odd.columns and {"gone", "row"} <= set(out.columns)
        out.collect()
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_mixed_document_is_split():
    rng = random.Random(3)
    prose = lambda: " ".join(f"word{rng.randrange(400)}" for _ in range(rng.randint(12, 30))).capitalize() + "."
    menu = lambda: " | ".join(f"item{rng.randrange(99)}" for _ in range(4))
    data = []
    for i in range(240):
        good = i % 3 > 0
        lines = [prose() for _ in range(rng.randint(3, 9))] if good else [prose() for _ in range(rng.randint(0, 2))] + [menu() for _ in range(rng.randint(8, 14))]
        lines = [x.encode() for x in lines]
        data.append((*linecrf.features(lines), linecrf.fresh_lines(lines), int(good)))
    crf = linecrf.fit_lines(data)
    text = "\n".join([menu(), menu(), *[prose() for _ in range(6)], menu()])
    label = crf.viterbi(linecrf.features(linecrf.lines_of(text))[0])
    assert label.tolist() == [0, 0, 1, 1, 1, 1, 1, 1, 0]
    assert linecrf.judge(text, crf)[6] and not linecrf.judge("\n".join([prose(), *[menu() for _ in range(30)]]), crf)[6]


def test_spans_in_order_of_size():
    text = "\n".join(f'password = "abcdefgh{i:06d}"; my_secret_key{i} = "q8Zr{i:06d}xW"' for i in range(12000))
    began = time.time()
    spans = secrets.scan(text)
    assert time.time() - began < 10 and sum(k == "literal" for k, *_ in spans) >= 11000
    base = [(s, e) for k, s, e, _ in spans if k != "literal"]
    few = [x for x in spans if x[0] == "literal"][:300]
    assert not any(s <= a and b <= e for _, a, b, _ in few for s, e in base)


def test_close_pairs_finds_all(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(jaccard, "LEAF", 16)
    sets = []
    for _ in range(12):
        middle = rng.integers(0, 1 << 63, int(rng.integers(40, 200))).astype(np.uint64)
        for _ in range(int(rng.integers(1, 40))):
            keep = middle[rng.random(len(middle)) > rng.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 12))).astype(np.uint64)])))
    s = np.stack([np.frombuffer(jaccard.sketch(x), np.uint16).astype(np.int16) for x in sets])
    n, index = np.array([len(x) for x in sets], np.int64), np.arange(len(sets))
    at = len(sets) * 2 // 3
    found = Counter()
    for i, j in jaccard.close_pairs(s, n, 85, index[:at], index[at:]):
        found.update((min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True))
    want = {(a, b) for a in range(at) for b in range(a + 1, len(sets)) if np.abs(s[a].astype(int) - s[b]).sum() <= jaccard.most_apart(n[a] + n[b], 85)}
    assert set(found) == want and max(found.values()) == 1
    linked = {(a, b) for a, b in want if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert linked


def test_word_states_against_counts(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "The cat ran", "a dog", "", None, "the cat sat", "zebra cat", "the the the"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tree = suffixlm.train(df)
    tokens = {d: [*[w.encode() for w in brute.words10(t)], suffixlm.END] for d, t in rows}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 5 != 1]
    one, two, ctx = Counter(), Counter(), Counter()
    for d in train:
        one.update(tokens[d])
        pairs = list(zip([None, *tokens[d]], tokens[d]))
        two.update(pairs)
        ctx.update(u for u, _ in pairs)
    n, v = sum(one.values()), len(one)

    def p(u, w):
        root = (one[w] + (v + 1) * 10 ** tree.spell([w])[0]) / (n + v + 1)
        back = suffixlm.KAPPA + ctx[u]
        return (two[u, w] + back * root) / (ctx[u] + back)

    got = {r.doc_id: r.score for r in suffixlm.score_texts(df, tree).collect()}
    for d, t in tokens.items():
        assert got[d] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip([None, *t], t)), abs=0.02)


def test_packed_keys():
    keys = np.unique(hashes([f"k{i}".encode() for i in range(1000)]))
    for part in (keys, keys[:1], keys[:0]):
        assert (suffixlm.unpack_sorted(suffixlm.pack_sorted(part), len(part)) == part).all()


def test_spelling_takes_bounded_memory(spark):
    tree = suffixlm.train(spark.createDataFrame([(1, "some words to spell")], "doc_id long, text string"))
    words = [b"w%d" % i for i in range(400_000)]
    some = tree.spell(words[:3000])
    tracemalloc.start()
    got = tree.spell(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[:3000], some) and got[123_456] == pytest.approx(tree.spell([words[123_456]])[0])
    assert peak < 100e6


def test_word_states_pass_a_divergence_test(spark, monkeypatch):
    monkeypatch.setattr(suffixlm, "BLOCK_TOKENS", 500)
    rng = random.Random(3)
    # "any", "odd", "x" and "y" are followed by what the root predicts anyway, "san" by one word only, "rare1" once
    texts = [" ".join(["san francisco", *(rng.choice(["any", "odd", "x", "y"]) for _ in range(800)), f"rare{i}"]) for i in range(12)]
    rows = [*enumerate([*texts, "", None, "san francisco any x", "unseen words"]), (None, "odd san francisco")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tree = suffixlm.train(df.where(suffixlm.fold(5) != 1))
    tokens = {d: [*[w.encode() for w in brute.words10(t)], suffixlm.END] for d, t in rows}
    one, two = Counter(), Counter()
    for d, t in tokens.items():
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            one.update(t)
            two.update(zip([None, *t], t))
    ctx = Counter()
    for (u, _), k in two.items():
        ctx[u] += k
    n, v = sum(one.values()), len(one)
    spelled = {w: 10 ** tree.spell([w])[0] for t in tokens.values() for w in t}

    def root(w):
        return (one[w] + (v + 1) * spelled[w]) / (n + v + 1)

    def after(u, w):
        back = suffixlm.KAPPA + ctx[u]
        return (two[u, w] + back * root(w)) / (ctx[u] + back)

    gain = Counter()
    for (u, w), k in two.items():
        gain[u] += k * math.log(after(u, w) / root(w))
    states = {u for u in ctx if gain[u] >= max(math.log(n), suffixlm.DIVERGENCE * ctx[u])}
    assert {None, b"san"} <= states and not states & {b"any", b"odd", b"x", b"y", b"rare1"}
    got = {r.doc_id: r.score for r in suffixlm.contract(df).collect()}
    assert len(got) == len(rows)
    for d, t in tokens.items():
        assert got[d] == pytest.approx(sum(math.log10(after(u, w) if u in states else root(w)) for u, w in zip([None, *t], t)), abs=0.03)
