"""The language model's score against one worked out token by token."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from quarrygraph.llm import language_model
from quarrygraph.llm.textvec import words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def softmax_log(z, k):
    z = z.astype(np.float64)
    return float(z[k] - z.max() - np.log(np.exp(z - z.max()).sum()))


def test_score_token_by_token(spark, monkeypatch):
    r = random.Random(8)
    # More words than the vocabulary has room for, and more than HEAVY.
    vocab = [f"w{int(r.random() ** 2 * 4_000)}" for _ in range(9_000)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 60))) for _ in range(300)] + ["", None, "never seen before", "W1 w1", " ".join(r.choice(vocab) for _ in range(3_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    training = docs.filter("doc_id % 5 <> 0")
    kept = {}

    def train(docs, vocabulary, tokens, original=language_model.train_network):
        kept["v"], kept["n"] = vocabulary, original(docs, vocabulary, tokens)
        return kept["n"]

    monkeypatch.setattr(language_model, "train_network", train)
    monkeypatch.setattr(language_model, "HEAVY", 1_500)
    got = {x.doc_id: x for x in language_model.score(spark, docs, training).collect()}
    tokens = lambda t: [*WORDS.findall((t or "").lower()), None]
    counts = collections.Counter(x for i, t in enumerate(texts) if i % 5 for x in tokens(t))
    v, net = kept["v"], kept["n"]
    assert net.learned == sum(counts.values())
    names = sorted({w for t in texts for w in WORDS.findall((t or "").lower())})
    number = dict(zip(names, words(pa.array(names))[0].view(np.int64).tolist(), strict=True))
    others = sum(c for w, c in counts.items() if w is not None and number[w] not in v.by_word)
    distinct = sum(w is not None and number[w] not in v.by_word for w in counts)
    assert v.size < distinct
    for i, t in enumerate(texts):
        h, total = np.zeros((1, language_model.HIDDEN), np.float32), 0.0
        for w in tokens(t):
            token = v.end if w is None else v.by_word.get(number[w], v.other)
            c, k = divmod(token, net.classes)
            total += (softmax_log(h[0] @ net.wc + net.bc, c) + softmax_log(h[0] @ net.ww[c] + net.bw[c], k)) / math.log(10)
            if token == v.other:
                total += math.log10((counts[w] + 0.5) / (others + 0.5 * (distinct + 1)))
            h = net.step(h, np.array([token]))
        assert math.isclose(got[i].score, total, rel_tol=1e-4), (i, got[i].score, total)
        assert got[i].n_known == sum(counts[w] > 0 for w in tokens(t))


def test_gradients_against_differences():
    """The gradient of a window's loss, for weights of every kind, against small steps of each."""
    rng = np.random.default_rng(3)
    net = language_model.Network(rng.integers(1, 50, 1024).astype(float))
    for k in language_model.WEIGHTS:
        setattr(net, k, (getattr(net, k) + rng.normal(0, 0.2, getattr(net, k).shape)).astype(np.float32))
    window, weight = rng.integers(0, 1024, (6, 40)), np.ones(240, np.float32)
    weight[[3, 77]] = 0
    end, h0 = int(window[2, 5]), rng.normal(0, 0.5, (40, language_model.HIDDEN)).astype(np.float32)

    def loss():
        h, total = h0, 0.0
        for t, tok in enumerate(window):
            total -= float((net.log_probs(h, tok) * weight[t * 40 : t * 40 + 40]).sum())
            h = net.step(h, tok) * (tok != end)[:, None]
        return total

    _, grads = net.gradients(h0, window, weight, end)
    for k, (rows, g) in grads.items():
        full = np.zeros_like(getattr(net, k))
        full[rows] = g
        at = np.unravel_index(int(np.abs(full).argmax()), full.shape)
        w, step = getattr(net, k), 0.01
        w[at] += step
        up = loss()
        w[at] -= 2 * step
        down = loss()
        w[at] += step
        assert math.isclose((up - down) / (2 * step), full[at], rel_tol=0.03), k
