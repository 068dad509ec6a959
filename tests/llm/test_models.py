"""Language model, licenses, mixing and the pipeline against plain versions and the odd rows."""

import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import licenses, mixing, queries, suffixlm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(80)


def base_scores(rows):
    tokens = {d: [*brute.words10(t), None] for d, t in rows}
    train = Counter(x for d, t in tokens.items() if zlib.crc32(str("" if d is None else d).encode()) % 5 != 1 for x in t)
    n, v = sum(train.values()), len(train)
    return {d: (len(t), sum(train[x] > 0 for x in t), n, sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for d, t in tokens.items()}


def test_word_counts_and_base_score(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = base_scores(rows)
    got = {r.doc_id: r for r in suffixlm.contract(docs).collect()}
    for d, (n, known, total, score) in want.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (n, known, total)
        assert abs(got[d].base_score - score) < 1e-6 * max(1, abs(score)) and got[d].score < 0


def test_suffix_tree_is_a_distribution(docs):
    tree = suffixlm.train(docs)
    assert sum(map(len, tree.states)) > 50
    rng = np.random.default_rng(0)
    seen = suffixlm.grams([b"the", b"and", b"of", b"that"])
    for g in [*seen[:8].tolist(), *rng.integers(0, 1 << 47, 8).tolist()]:
        every = (np.int64(g) & ~np.int64(255)) | np.arange(256)
        assert abs((10 ** tree.gram_logs(every)).sum() - 1) < 1e-6
    assert suffixlm.train(docs.where(F.lit(False))).spell([b"a", b"\n"]).tolist() == pytest.approx([2 * math.log10(1 / 256), math.log10(1 / 256)])


def words3(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def test_licenses_against_plain_containment(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [(1, "a b c\nLicensed under the Apache License, Version 2.0."), (2, filler + " released under the MIT license " + filler), (3, filler), (4, None), (5, "Licensed under CC BY-NC 4.0."),
            (6, "licensed under the GNU General Public License, version 3"), (7, "permission is hereby granted free"), (8, "")]
    sets = {n: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for n, w in ((n, words3(t)) for n, t in licenses.TEMPLATES.items())}
    want = {}
    for d, t in rows:
        w = words3(t)
        mine = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        want[d] = sorted(n for n, s in sets.items() if len(s & mine) >= 0.8 * len(s))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.contract(df).collect()}
    assert got == {d: ",".join(x) for d, x in want.items()}
    assert "Python" not in licenses.contract(df)._jdf.queryExecution().executedPlan().toString()


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out, names, report = mixing.mix(d, mixing.labelled_rows(d, labels), "lang", {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25})
    assert names == ["de", "en", "es", "fr"] and report["residual"] < 1e-4
    rows = out.toPandas()
    assert (rows["rate"] >= 0).all() and len(rows) == 1000
    assert all(abs((rows["rate"] * rows["tokens"] * rows[f"p{j}"]).sum() / rows["tokens"].sum() - 0.25) < 1e-3 for j in range(4))


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (7, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    none = odd.where(F.lit(False))
    assert suffixlm.contract(odd).count() == odd.count() and suffixlm.contract(none).count() == 0
    assert licenses.contract(odd).count() == odd.count() and licenses.contract(none).count() == 0
    assert mixing.contract(odd, labels).count() == odd.select("doc_id").distinct().count() and mixing.contract(none, labels).count() == 0
    assert mixing.contract(odd, labels.where(F.lit(False))).where("rate <> 1").count() == 0
    assert set(odd.columns) <= set(mixing.sample_mixture(odd, labels).columns)


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "n-gram jaccard join" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = [(r.doc_id, r.text) for r in out.select("doc_id", "text").distinct().collect()]
    assert len({d for d, _ in rows}) == len(rows) > 50
    assert all(c == d for d, (_, c) in brute.jaccard(rows, 5, 80).items())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert all(v[1] < 8 for v in brute.decontaminate(rows, bench).values())
    assert not any(brute.secrets(t) for _, t in rows)


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()) == list(range(1, 11))
