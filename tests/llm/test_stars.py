"""Components by stars: right for chains and rings, and no round where only stars are left."""

import pytest

from assayer.llm import hyper_minhash

STAR = [(0, k) for k in range(1, 9)]
CHAIN = [(k, k + 1) for k in range(30)]
SHUFFLED = [(k * 7 % 31, (k + 1) * 7 % 31) for k in range(30)] + [(40, 41), (42, 41), (50, 50)]


def roots_of(links):
    root = {k: k for pair in links for k in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {k: r for k, r in root.items() if k != r}


@pytest.mark.parametrize("links, most", [(STAR, 1), (CHAIN, 8), (SHUFFLED, 8), ([], 1)])
def test_rounds_end_with_stars(spark, monkeypatch, links, most):
    rounds = []
    staged = hyper_minhash.staged
    monkeypatch.setattr(hyper_minhash, "staged", lambda df, name: (rounds.append(name), staged(df, name))[1])
    found = hyper_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.root for r in found} == roots_of(links)
    assert len(rounds) <= most, "stars need no further round"
