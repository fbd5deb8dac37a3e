"""The latent space of decontamination against a dense product over every document and item."""

import random

import numpy as np

from tabulon.llm import decontamination as D


def test_space_is_fitted_on_all_documents_and_items(spark):
    r = random.Random(3)
    words = [f"w{k}x" for k in range(1500)]
    texts = [" ".join(r.choice(words) for _ in range(8)) for _ in range(9000)]
    items = [" ".join(r.choice(words) for _ in range(8)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([(i, t, None) for i, t in enumerate(items)], "item_id long, text string, answer string")
    space, stop, idf = D.learn_space(docs, bench)
    t = D.coarse(D.terms(D.split_words(texts + items)[0])).reshape(-1, 8)
    assert not stop.any() and len(t) == 9060

    used, at = np.unique(t, return_inverse=True)
    rows = np.zeros((len(t), len(used)))
    np.add.at(rows, (np.arange(len(t))[:, None], at.reshape(t.shape)), idf[t])
    w = np.random.default_rng(5).standard_normal((D.TERMS, D.RANK), np.float32)[used]
    q, upper = np.linalg.qr(rows.T @ (rows @ w / (idf[t] ** 2).sum(1)[:, None]))
    u, s, _ = np.linalg.svd(upper)
    want = q @ (u / np.sqrt(s)) * idf[used][:, None]
    got = space[used]
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-3 * np.abs(want @ want.T).max()
    assert np.abs(np.delete(space, used, axis=0)).max() < 1e-9
