"""The network's arithmetic by classes and parts against a plain version of it, and lookups by buckets against a dictionary."""

import numpy as np
import pyarrow as pa

from quarrygraph.llm import language_model as lm
from quarrygraph.llm.textvec import U, words


def plain_softmax_log(z, right):
    m = z.max(-1, keepdims=True)
    return np.take_along_axis(z - m - np.log(np.exp(z - m).sum(-1, keepdims=True)), right[:, None], -1)[:, 0]


def network(rng, classes=32):
    net = lm.Network(rng.integers(1, 50, classes**2).astype(float))
    for k in lm.WEIGHTS:
        setattr(net, k, (getattr(net, k) + rng.normal(0, 0.3, getattr(net, k).shape)).astype(np.float32))
    return net


def test_output_gradients_by_class():
    """Classes with no row, few, exactly a tile, and enough to be computed alone, and values that need the largest subtracted."""
    rng = np.random.default_rng(1)
    net = network(rng)
    cls = np.repeat([0, 1, 2, 3, 5, 9, 31], [700, 1, 8, 9, 63, 64, 65])
    token = rng.permutation(cls * 32 + rng.integers(0, 32, len(cls)))
    weight = rng.random(len(token)).astype(np.float32)
    for grown in (1, 200):
        net.bw = net.bw * grown
        flat = np.ones((len(token), lm.HIDDEN + 1), np.float32)
        flat[:, :-1] = rng.normal(0, 0.5, (len(token), lm.HIDDEN))
        g_c, g_w, outer = net._outputs(flat, token, weight)
        want_c, want_w, want = np.zeros(net.c.shape), np.zeros(net.w.shape), np.zeros(outer.shape)
        for x, t, v, at in zip(flat.astype(float), token, weight, range(len(token)), strict=True):
            for w, g, k in ((net.c, want_c, t // 32), (net.w[t // 32], want_w[t // 32], t % 32)):
                z = x @ w
                p = np.exp(z - z.max())
                p /= p.sum()
                p[k] -= 1
                g += v * np.outer(x, p)
                want[at] += v * (w[:-1] @ p)
        for a, b in ((g_c, want_c), (g_w, want_w), (outer, want)):
            assert np.abs(a - b).max() < 1e-3 * max(1, np.abs(b).max())
        plain = plain_softmax_log(flat @ net.c, token // 32) + plain_softmax_log(np.einsum("ij,ijk->ik", flat, net.w[token // 32]), token % 32)
        assert np.allclose(net.log_probs(flat[:, :-1], token), plain, rtol=1e-4, atol=1e-3)


def test_learning_is_adam():
    rng = np.random.default_rng(2)
    net, plain, tokens = network(rng), network(np.random.default_rng(2)), rng.integers(0, 1024, 3_000) // 3
    net.learn([tokens], 7, len(tokens), 0.01, 4)
    steps = -(-len(tokens) // (4 * lm.WINDOW))
    full = np.concatenate([tokens, np.full(4 * steps * lm.WINDOW - len(tokens), 7)])
    stream, counted = full.reshape(4, -1).T, (np.arange(len(full)) < len(tokens)).astype(np.float32).reshape(4, -1).T
    h, read = np.zeros((4, lm.HIDDEN), np.float32), 0
    m1, m2 = ({k: np.zeros(getattr(plain, k).shape) for k in lm.WEIGHTS} for _ in range(2))
    for t in range(steps):
        at = slice(t * lm.WINDOW, (t + 1) * lm.WINDOW)
        weight = counted[at].ravel()
        h, grads = plain.gradients(h, stream[at], weight, 7)
        read += weight.sum()
        lr = 0.01 * max(0.1, 1 - read / len(tokens)) * np.sqrt(1 - 0.999 ** (t + 1)) / (1 - 0.9 ** (t + 1))
        for k, (rows, g) in grads.items():
            g = g / weight.sum()
            m1[k][rows] = 0.9 * m1[k][rows] + 0.1 * g
            m2[k][rows] = 0.999 * m2[k][rows] + 0.001 * g * g
            getattr(plain, k)[rows] -= lr * m1[k][rows] / (np.sqrt(m2[k][rows]) + 1e-8)
    assert np.abs(net.flat() - plain.flat()).max() < 2e-3


def test_lookup_by_buckets():
    texts = pa.array(["a b c A zz", None, "", " ".join(f"w{k}" for k in range(3_000))])
    h, n = words(texts, lower=True)
    for known in (np.zeros(0, U), np.unique(h[:1]), np.unique(h[::2]), np.unique(np.concatenate([h, np.arange(50, dtype=U), U(2**64 - 1) - np.arange(50, dtype=U)]))):
        ids = np.arange(len(known), dtype=np.int32) * 3
        place = dict(zip(known.tolist(), ids.tolist(), strict=True))
        got = lm.tokens_of(texts, known, lm.buckets(known), ids, -1)
        assert got[1].tolist() == [place.get(x, -1) for x in h.tolist()] and got[2].tolist() == n.tolist()
