"""Rows with a null id cost documents with ids none of their links."""

import itertools

import brute
import pytest

from lattica.llm import jaccard


@pytest.mark.parametrize("seed", range(3))
def test_null_id_sets_do_not_hide_links(spark, seed):
    words = [f"s{seed}w{i}" for i in range(60)]
    # two linked documents and null-id near copies, among them the common part
    texts = [" ".join(words + ["x"]), " ".join(words + ["y"]), " ".join(words), *(" ".join(words + [f"n{i}"]) for i in range(12))]
    tables = []
    for a, b in itertools.combinations(range(3), 2):  # of the three first texts, each is once without an id, so each key order occurs
        ids = {a: 1, b: 2}
        tables.append([(ids.get(i), t) for i, t in enumerate(texts)])
    rows = [(None if d is None else d + 10 * k, t.replace("s", f"t{k}s")) for k, table in enumerate(tables) for d, t in table]
    got = {r.doc_id: r.component_id for r in jaccard.contract(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None}
    want = brute.jaccard([r for r in rows if r[0] is not None], 4, 85)
    assert got == {d: c for d, (_, c) in want.items()} == {1: 1, 2: 1, 11: 11, 12: 11, 21: 21, 22: 21}
