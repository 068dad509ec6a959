"""The contracts of the scanning and scoring operators against plain versions, and the odd rows."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontam, jaccard, linecrf, quality, secrets, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(df):
    return df.where(F.lit(False))


def test_secrets_base_spans(docs, rows):
    got = {r.doc_id: r for r in secrets.contract(docs).collect()}
    for d, t in rows:
        want = brute.secrets(t)
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [sum(x[3] == k for x in want) for k in ("assign", "access", "hex")]


def test_secrets_adds_literals_and_propagates_constants():
    text = 'SIGNING_SALT = "q8Zr4TtP0xLm"\nauthKey = SIGNING_SALT\nprivate_key: "ab" + "Xy9_Zw7Q2k"\ntitle = "a plain long title"\nsecret:token:abcdefghijk'
    found = [(k, text[s:e]) for k, s, e, _ in secrets.scan(text)]
    assert ("literal", "q8Zr4TtP0xLm") in found
    assert any(k == "literal" and "Xy9_Zw7Q2k" in v for k, v in found)
    assert not any("plain" in v for _, v in found)
    assert brute.secrets(text) == sorted((s, secrets.KINDS.index(k), e, k) for k, s, e in secrets.base_spans(text))


def test_redact_keeps_clean_text():
    assert secrets.redact("nothing to see: here") == "nothing to see: here"
    assert secrets.redact(None) is None
    out = secrets.redact("x password=abcdefgh1 y")
    assert out == "x [REDACTED] y"


def test_decontamination(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.decontaminate(rows, [(r.item_id, r.text) for r in bench.collect()])
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contract(docs, bench).collect()}
    assert got == want
    small = decontam.match_phrases(docs, bench, block=300)  # many blocks give the same
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in small.collect()} == {d: w[:3] for d, w in want.items()}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha " + "x " * 40 + "beta"), (3, "beta alpha")], "doc_id long, text string")
    got = {(r.doc_id, r["query"]) for r in decontam.match_proximity(docs, {7: "alpha beta"}, span=4).collect()}
    assert got == {(1, 7), (3, 7)}


def test_line_rules(docs, labels, rows):
    got = {r.doc_id: r for r in linecrf.contract(docs, labels).collect()}
    for d, t in rows:
        want = brute.rules(t)
        assert tuple(got[d])[1:6] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[d].base_failed == failed and not (failed and got[d].kept)
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    assert all(got[d].kept for d in good if not got[d].base_failed)


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    crf = linecrf.LineCrf(rng.normal(size=(2, linecrf.N_FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
    x = rng.integers(0, 2, (6, linecrf.N_FEATURES)).astype(float)
    e = x @ crf.emit.T

    def score(y):
        return crf.start[y[0]] + sum(e[i][l] for i, l in enumerate(y)) + sum(crf.move[a][b] for a, b in zip(y, y[1:]))

    best = max(itertools.product((0, 1), repeat=6), key=score)
    assert tuple(crf.viterbi(x)) == best


def test_warc_round_trip(spark):
    same, small = "é" * 600, "tiny"
    rows = [(1, "u1", same), (5, "u5", same), (3, None, same), (4, "a\r\nb", None), (6, "u", ""), (7, "u7", small), (8, "u8", small), (9, "x" * 9, "z" * 1000), (None, "n", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.scratch(spark, "test")
    index = warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    assert len(got) == len(rows)
    for p, u, h in rows:
        data = (h or "").encode()
        r = got[p]
        assert (r.url, r.payload_bytes, r.payload_digest) == (u, len(data), hashlib.sha1(data).hexdigest())
        again = h == same and p != 5
        assert (r.record_type, r.refers_to) == (("revisit", 5) if again else ("response", None))
        assert r.payload == (None if again else data) or bytes(r.payload or b"") == data
    some = index.where("page_id in (7, 9)")
    assert {r.page_id for r in warc.read_records(some, folder).collect()} == {7, 9}
    assert warc.contract(empty(pages)).count() == 0


@pytest.mark.parametrize("run", [toxicity.contract, quality.contract])
def test_classifiers(spark, run):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = run(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    y = out["toxic" if run is toxicity.contract else "quality"]
    assert out["score"].between(0, 1).all()
    assert (out["predicted"] == y).mean() > 0.9


def test_odd_rows_and_empty_tables(spark, odd, labels):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again"), (2, None), (None, "a b"), (3, "lazy dog again"), (3, "")], "item_id long, text string")
    runs = {
        "tox": lambda d: toxicity.contract(d, labels), "qual": lambda d: quality.contract(d, labels), "sec": secrets.contract, "dec": lambda d: decontam.contract(d, bench),
        "line": lambda d: linecrf.contract(d, labels), "jac": jaccard.contract,
    }
    for name, run in runs.items():
        got = run(odd).collect()
        assert len(got) == odd.count(), name
        assert run(empty(odd)).count() == 0, name
    for name in ("tox", "qual", "line"):
        run = {"tox": toxicity, "qual": quality, "line": linecrf}[name].contract
        assert run(odd, empty(labels)).count() == odd.count()
    assert decontam.contract(odd, empty(bench)).where("n_items > 0").count() == 0
    hit = {r.doc_id: r for r in decontam.contract(odd, bench).collect()}
    assert hit[1].n_items == 2 and hit[1].contaminated and hit[3].n_words == 0
    jac = {r.doc_id: r for r in jaccard.contract(odd).collect()}
    assert jac[2].component_id == 1 and jac[3].n_shingles == 0 and jac[3].component_id == 3
    assert secrets.redact_secrets(odd).columns == odd.columns
    assert jaccard.keep_one(odd).columns == odd.columns
    kept = [r.doc_id for r in jaccard.keep_one(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 4, 5, 6, 7] and None in kept
