"""Recall of the registered settings: planted pairs at the threshold, scattered and in a crowd, and exact counts where found."""

import numpy as np
import pytest

from trackloom.llm import embeddings

D, PAIRS = 64, 400


def pair(rng, x, cosine):
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x / (x * x).sum(axis=1, keepdims=True)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * noise


@pytest.mark.parametrize("cone", [0.0, 0.75])
def test_planted_pairs_at_the_threshold_meet(spark, cone):
    rng = np.random.default_rng(5)
    axis = rng.standard_normal(D)
    axis /= np.linalg.norm(axis)
    x = rng.standard_normal((6000, D))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if cone:  # a third of all vectors close together, below the threshold
        x[::3] = np.sqrt(cone) * axis + np.sqrt(1 - cone) * x[::3]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = x[:PAIRS]
    every = np.concatenate([x, pair(rng, a, 0.903)])
    rows = [(i, v.tolist()) for i, v in enumerate(every)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    want, found = links.sum(axis=1), np.array([got[i].n_links for i in range(len(every))])
    assert want.sum() >= 2 * PAIRS and (found <= want).all()
    assert found.sum() >= 0.99 * want.sum()
    print("recall", found.sum() / want.sum())
