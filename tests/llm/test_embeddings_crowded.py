"""Planted pairs in a hot cone, where far more vectors than the window share their hash bits."""

import numpy as np

from trackloom.llm import embeddings


def test_pairs_in_a_hot_cone_meet(spark):
    rng = np.random.default_rng(3)
    n, d, pairs = 3000, 64, 100
    axis = np.zeros(d)
    axis[0] = np.sqrt(3.0)
    unit = lambda k: (y := rng.standard_normal((k, d)) * (np.arange(d) > 0)) / np.linalg.norm(y, axis=1, keepdims=True)
    own = unit(n)
    other = unit(pairs)
    other -= (other * own[:pairs]).sum(axis=1, keepdims=True) * own[:pairs]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = 4 * 0.905 - 3  # cosine 0.905 with the axis added
    x = np.concatenate([own, c * own[:pairs] + np.sqrt(1 - c * c) * other]) + axis
    x = np.concatenate([x, rng.standard_normal((2 * n, d))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T >= 0.9
    np.fill_diagonal(sim, False)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, window=16, block=64, tile=256).collect()}
    want = {i: int(k) for i, k in enumerate(sim.sum(axis=1))}
    planted = [i for i in range(pairs) if want[i]]
    assert len(planted) == pairs and sum(got[i] == want[i] for i in planted) >= 0.99 * pairs
    assert all(got[i] <= want[i] for i in want)
