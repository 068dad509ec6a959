"""Rows with a null or a repeated id are judged by themselves and cost other rows nothing."""

from lattica.llm import decontam, mixing

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota"


def test_decontamination_judges_rows_not_ids(spark):
    rows = [(None, f"so {ITEM} it is"), (None, "a clean text"), (None, "another clean text"), (None, None), (5, ITEM), (5, "a clean text of a repeated id"), (6, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([r for r in rows if ITEM not in (r[1] or "")], key=str)


def test_mixing_rates_rows_not_ids(spark):
    word = {"en": "the house stands there", "fr": "la maison est belle"}
    rows = [(i, word[lang] + f" {i}", lang) for i in range(40) for lang in ("en" if i % 2 else "fr",)]
    nulls = [(None, word[lang] + f" row {i}", lang) for i in range(60) for lang in ("en" if i % 2 else "fr",)]
    docs = spark.createDataFrame(rows + nulls, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    got = mixing.sample_mixture(docs, labels, targets={"en": 1.0, "fr": 0.6})
    assert got.columns == [*docs.columns, "rate"]
    out = got.collect()
    null_rates = {lang: {r["rate"] for r in out if r.doc_id is None and r["lang"] == lang} for lang in ("en", "fr")}
    assert min(null_rates["en"]) > 1 and all(x < 1 for x in null_rates["fr"])  # by the row's own text
    copies = [sum(r.text == t for r in out) for _, t, lang in nulls if lang == "fr"]
    assert 0 in copies and 1 in copies  # neither all gone nor all kept
