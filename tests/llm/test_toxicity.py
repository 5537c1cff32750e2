import re

import numpy as np
import pytest
from cases import no_documents, odd_documents
from conftest import rows
from pyspark.sql import functions as F

from pricelane.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def network(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels, ~toxicity.held_out())


def test_held_out(spark, network):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(toxicity.held_out()).join(labels, "doc_id")
    found = toxicity.scored(docs, network).join(labels, "doc_id").toPandas()
    toxic, clean = found[found.toxic == 1].score, found[found.toxic == 0].score
    assert len(toxic) > 50
    assert (toxic >= 0.5).mean() >= 0.9 and (clean < 0.5).mean() >= 0.95
    assert (toxic.to_numpy()[:, None] > clean.to_numpy()[None, :]).mean() >= 0.97


def test_windows_cover_all_words():
    for size in (0, 1, 63, 64, 65, 112, 113, 1000):
        _, start, length = toxicity.windows(np.array([0, size]))
        seen = set().union(*(range(a, a + n) for a, n in zip(start, length)))
        assert seen == set(range(size)) and (length <= toxicity.WINDOW).all()


def test_one_toxic_word_counts_anywhere(network):
    clean = b"the of and to in is " * 400
    scores = network.scores([clean, b"idiot worthless scum moron loser " + clean,
                             clean + b" idiot worthless scum moron loser", clean[:1200] + b" idiot scum loser " + clean[1200:]])
    assert scores[0] < 0.5 and min(scores[1:]) > 0.5


def test_batches_do_not_matter(network):
    texts = [b"idiot the of", b"", b"the and of to " * 90, b"moron " * 70, "é ñ".encode()]
    alone = [network.scores([t])[0] for t in texts]
    assert np.allclose(network.scores(texts), alone, atol=1e-5)


def test_gradients():
    texts = [b"idiot abc def", b"hello world abc def ghi", b"x", b""]
    vocab, token, bounds = toxicity.vocabulary(texts)
    network = toxicity.Network(vocab.hashes[:4])
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    text, start, length = toxicity.windows(bounds)
    order = np.argsort(-length, kind="stable")
    start, length, target = start[order], length[order], np.array([1, 0, 1, 0.0])[text[order]]

    def loss():
        odds = network.forward(network.inputs(vocab, network.rows_of(vocab)), token, start, length)
        return np.mean(np.log1p(np.exp(odds)) - target * odds)

    found = network.gradient(vocab, network.rows_of(vocab), token, start, length, target)
    for name, weights in network.w.items():
        flat, slope = weights.reshape(-1), found[name].reshape(-1)
        for i in np.argsort(-abs(slope))[:3]:
            was = flat[i]
            flat[i] = was + 1e-3
            above = loss()
            flat[i] = was - 1e-3
            assert abs((above - loss()) / 2e-3 - slope[i]) < 1e-4, name
            flat[i] = was


def test_odd_rows(spark, network):
    docs = odd_documents(spark)
    found = rows(toxicity.scored(docs, network))
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    empty = {r["score"] for r in found if r["doc_id"] in (3, 4, 5)}
    assert len(empty) == 1
    assert toxicity.scored(no_documents(spark), network).count() == 0


def test_without_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    network = toxicity.train(docs, labels, F.lit(True))
    assert {round(r["score"], 6) for r in rows(toxicity.scored(docs, network))} == {0.5}
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    network = toxicity.train(docs, labels, F.lit(True))
    assert all(r["score"] < 0.5 for r in rows(toxicity.scored(docs, network)))


def plain_score(network, text):
    """One text by loops over its windows, the steps of each and the two directions, one vector at a time."""
    w = {k: v.astype(np.float64) for k, v in network.w.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    size = toxicity.HIDDEN

    def vector(word):
        own, _, _ = toxicity.vocabulary([word])
        at = np.flatnonzero(network.known == own.hashes[0])
        return np.concatenate([w["word"][at[0] if len(at) else -1], np.mean([w["char"][s] for s in own.slots], axis=0)])

    def states(side, vectors):
        h, found = np.zeros(size), []
        for x in vectors:
            given, before = x @ w[f"{side}_in"] + w[f"{side}_bias"], h @ w[f"{side}_rec"]
            z = sigmoid(given[:size] + before[:size])
            r = sigmoid(given[size:2 * size] + before[size:2 * size])
            new = np.tanh(given[2 * size:] + r * before[2 * size:])
            h = z * h + (1 - z) * new
            found.append(h)
        return found

    read = [m for m in re.findall(rb"[a-z\x80-\xff]+", text.lower())]
    odds, at = [], 0
    while True:
        vectors = [vector(word) for word in read[at:at + toxicity.WINDOW]]
        if vectors:
            both = [np.concatenate(s) for s in zip(states("f", vectors), states("b", vectors[::-1])[::-1])]
            mark = np.array([s @ w["attend"] for s in both])
            weight = np.exp(mark - mark.max())
            pooled = sum(a * s for a, s in zip(weight / weight.sum(), both))
        else:
            pooled = np.zeros(2 * size)
        odds.append(pooled @ w["out"] + w["bias"][0])
        if at + toxicity.WINDOW >= len(read):
            return sigmoid(max(odds))
        at += toxicity.STRIDE


def test_scores_against_plain_loops(spark, network):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(25).collect()]
    texts += ["", "1 2 3", "Idiot", "the and of " * 60, "é" * 30 + " ñandú x"]
    given = [(t or "").encode() for t in texts]
    assert max(len(t) for t in given) > 2000
    found = network.scores([t.lower() for t in given])
    assert np.allclose(found, [plain_score(network, t) for t in given], atol=2e-4)
