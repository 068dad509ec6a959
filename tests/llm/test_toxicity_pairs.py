"""Terms that are neutral alone and tell the classes only together."""

import numpy as np

from lattica.llm import toxicity


def planted(n, seed=0):
    """Two terms, each as frequent in clean as in toxic texts; toxic are texts with both or none."""
    rng = np.random.default_rng(seed)
    texts, y = [], []
    for _ in range(n):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join([f"n{x}" for x in rng.integers(0, 2000, 30)] + ["groupterm"] * a + ["otherterm"] * b))
        y.append(float(a == b))
    return texts, np.array(y)


def test_pairs_without_marginal_signal():
    texts, y = planted(3000)
    features = [toxicity.terms(t) for t in texts]
    pair = toxicity.terms("groupterm otherterm")
    assert not np.isin(pair, toxicity.select(features[:2400], y[:2400], 4096)).any()
    model = toxicity.fit(features[:2400], y[:2400])
    assert (model.slot[pair] >= 0).all()
    assert ((model.scores(texts[2400:]) >= 0.5) == y[2400:]).mean() > 0.9


def test_every_bucket_seen_has_a_slot_and_scores_do_not_depend_on_runs():
    texts, y = planted(300)
    model = toxicity.fit([toxicity.terms(t) for t in texts], y)
    assert all((model.slot[toxicity.terms(t)] >= 0).all() for t in texts)
    assert np.allclose(model.scores(texts), model.scores(texts, entries=40))
    assert len(model.scores([])) == 0 and len(model.scores([None, ""])) == 2
