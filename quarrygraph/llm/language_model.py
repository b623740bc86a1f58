"""Language-model scores: a gated recurrent network with a class-factored softmax, above word counts of the whole corpus.

The network reads a vocabulary of the most frequent training words, one token for all others and
one for the end of a text. A word outside the vocabulary is scored as the network's token for
such words times its share of them in the counts of all training texts, so that the score is a
probability of the text itself. State is carried from window to window over the whole text.

Counts cover all training documents, and so does the network, trained in numpy by backpropagation
truncated to WINDOW steps: it starts on a sample (START_DOCS documents by smallest hashes of doc_id,
START_TOKENS tokens), then every part of about SHARD training tokens goes on from there over its
whole texts, and the parts' weights are averaged by their tokens. Its vocabulary grows with the root
of the training tokens. Words are told apart by 64-bit hashes.

Defined cases: a null or empty text is one end token; a null doc_id belongs to neither part and is
not learned from; repeated rows are scored alike, each on its own; without training
texts all counts are 0 and the network is as it starts; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, small_batches
from .quality_classifier import remainder
from .textvec import U, words

#: Classes of the smallest vocabulary; there are as many classes as tokens in each.
CLASSES, HIDDEN = 32, 16
GROWTH = 1.5
WINDOW = 16
START_DOCS, START_TOKENS, EPOCHS, LANES = 1_000, 400_000, 2, 64
#: Training tokens of a part that one task learns from, tokens that it holds at once, lanes and rate.
SHARD, CHUNK, SHARD_LANES, SHARD_RATE = 4_000_000, 1_000_000, 256, 0.005
#: Words whose counts every task holds (20 bytes each), or as many as the vocabulary has, if more. The counts of all other words are joined.
HEAVY = 1 << 20
END_WORD = 0
#: Tokens that a task scores together.
TOKENS = 3_000_000
#: Rows whose softmax is computed together (what stays in a core's cache), what a smaller class's rows are filled up to a multiple of, rows from which a class is
#: computed by itself, weights that are updated together, and weights of a row in the sum over the parts.
_ROWS_AT_ONCE, _TILE, _ALONE, _STEP, _PART = 512, 8, 64, 16_384, 65_536
#: Texts that are scored together, and rows of theirs whose softmax is computed class by class.
_TEXTS, _SORTED = 1_024, 32_768


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total, texts = [], 0, 0

    def flush() -> pa.RecordBatch:
        w, n = np.unique(np.concatenate([*held, np.full(texts, END_WORD, U)]) if held else np.zeros(0, U), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    for whole in batches:
        for batch in slices(whole):
            h, _ = words(batch.column("text"), lower=True)
            held.append(h)
            total, texts = total + len(h), texts + batch.num_rows
            if total >= TOKENS:
                yield flush()
                held, total, texts = [], 0, 0
    yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the lower-cased texts of docs; the end of every text counts as END_WORD."""
    return docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


def classes_for(tokens: int) -> int:
    """Classes of the vocabulary after so many training tokens; the vocabulary has the square of it, GROWTH ** 2 times the root of the tokens."""
    return max(CLASSES, math.ceil(GROWTH * tokens**0.25))


class Vocabulary:
    """The network's tokens, by falling count: words, the end, and all other words as one. Neighbours in rank form classes."""

    def __init__(self, ranked: list[tuple[int, int]], tokens: int):
        self.classes = classes_for(tokens)
        room = self.classes**2 - 2
        own = [(w, c) for w, c in ranked if w != END_WORD][:room]
        end = next((c for w, c in ranked if w == END_WORD), 0)
        other = tokens - end - sum(c for _, c in own)
        order = sorted([*((c, 0, w) for w, c in own), (end, 1, 0), (other, 2, 0)], key=lambda x: (-x[0], x[1], x[2]))
        self.end = next(i for i, x in enumerate(order) if x[1] == 1)
        self.other = next(i for i, x in enumerate(order) if x[1] == 2)
        self.by_word = {w: i for i, (_, kind, w) in enumerate(order) if kind == 0}
        self.size = len(own)
        self.other_tokens = other
        counts = np.ones(self.classes**2)
        counts[: len(order)] += [max(0, x[0]) for x in order]
        self.counts = counts


WEIGHTS = ("x", "u", "wc", "bc", "ww", "bw")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _halved(w: np.ndarray) -> np.ndarray:
    """A copy with the columns of both gates halved: 2 * sigmoid(x) = tanh(x / 2) + 1."""
    w = w.copy()
    w[:, : 2 * HIDDEN] *= 0.5
    return w


def _advance(u: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u @ h, both gates, the new part, the next state); a column for each lane, u and x halved."""
    n = HIDDEN
    a = u @ h
    zr = x[: 2 * n] + a[: 2 * n]
    np.tanh(zr, out=zr)
    zr += 1
    zr *= 0.5
    new = zr[n:] * a[2 * n :]
    new += x[2 * n :]
    np.tanh(new, out=new)
    out = h - new
    out *= zr[:n]
    out += new
    return a, zr, new, out


def _runs(cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in the order of their class, where each class begins, rows of each class)."""
    n = np.bincount(cls, minlength=classes)
    return np.argsort(cls.astype(np.int16 if classes < 1 << 15 else np.int64), kind="stable"), np.cumsum(n) - n, n


def _tiles(order: np.ndarray, begin: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, their rows) of the classes of under _ALONE rows, those together whose rows fill as many multiples of _TILE; -1 where there is no row."""
    size = np.where(n < _ALONE, -(-n // _TILE), 0)
    order = np.append(order, -1)
    for k in np.unique(size[size > 0]).tolist():
        same = np.flatnonzero(size == k)
        for c in (same[a : a + max(1, _ROWS_AT_ONCE // (k * _TILE))] for a in range(0, len(same), max(1, _ROWS_AT_ONCE // (k * _TILE)))):
            at = np.arange(k * _TILE)
            yield c, order[np.where(at < n[c, None], begin[c, None] + at, len(order) - 1)]


def _summed(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at first: the places of every run that come early are added together, what is left of long ones by itself."""
    out = rows[first]
    length = np.diff(np.append(first, len(rows)))
    for k in range(1, 9):
        some = np.flatnonzero(length > k)
        if not len(some):
            return out
        out[some] += rows[first[some] + k]
    for j in np.flatnonzero(length > 9).tolist():
        out[j] += rows[first[j] + 9 : first[j] + length[j]].sum(0)
    return out


def _adam(g: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, lr: float) -> None:
    """One step of the weights w against the gradient g; a is ten times its running mean, b a thousand times its square's. All are overwritten."""
    a *= np.float32(0.9)
    a += g
    g *= g
    b *= np.float32(0.999)
    b += g
    np.sqrt(b, out=g)
    g += np.float32(1e-8 * math.sqrt(1000))
    np.divide(a, g, out=g)
    g *= np.float32(lr * 0.1 * math.sqrt(1000))
    w -= g


class Network:
    """A gated recurrent layer whose input weights are looked up by token, and a softmax over classes, then over a class's tokens."""

    def __init__(self, counts: np.ndarray, seed: int = 5):
        rng, h, c = np.random.default_rng(seed), HIDDEN, math.isqrt(len(counts))
        share = counts.reshape(c, c)
        self.classes, self.learned = c, 0
        self.x = rng.normal(0, 0.1, (c * c, 3 * h)).astype(np.float32)
        self.u = rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)).astype(np.float32)
        # The biases stand below the weights, as what a state's last element, 1, is multiplied with.
        self.c, self.w = np.zeros((h + 1, c), np.float32), np.zeros((c, h + 1, c), np.float32)
        self.bc = np.log(share.sum(1) / share.sum())
        self.bw = np.log(share / share.sum(1, keepdims=True))

    wc = property(lambda self: self.c[:-1], lambda self, value: self.c[:-1].__setitem__(..., value))
    bc = property(lambda self: self.c[-1], lambda self, value: self.c[-1].__setitem__(..., value))
    ww = property(lambda self: self.w[:, :-1], lambda self, value: self.w[:, :-1].__setitem__(..., value))
    bw = property(lambda self: self.w[:, -1], lambda self, value: self.w[:, -1].__setitem__(..., value))

    def flat(self) -> np.ndarray:
        """All weights as one vector."""
        return np.concatenate([getattr(self, k).ravel() for k in WEIGHTS])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k in WEIGHTS:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def step(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        x, a = self.x[token], h @ self.u
        n = HIDDEN
        zr = _sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
        new = np.tanh(x[:, 2 * n :] + zr[:, n:] * a[:, 2 * n :])
        return new + zr[:, :n] * (h - new)

    def log_probs(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token after the state in its row."""
        x = np.ones((len(h), HIDDEN + 1), np.float32)
        x[:, :-1] = h
        cls, within = np.divmod(token, self.classes)
        out = np.empty(len(x), np.float32)
        for a in range(0, len(x), _ROWS_AT_ONCE):
            b = slice(a, a + _ROWS_AT_ONCE)
            out[b] = self._log_softmax(x[b] @ self.c, cls[b])
        order, begin, n = _runs(cls, self.classes)
        x, within = x[order], within[order]
        for c in np.flatnonzero(n).tolist():
            for a in range(begin[c], begin[c] + n[c], _ROWS_AT_ONCE):
                b = slice(a, min(a + _ROWS_AT_ONCE, begin[c] + n[c]))
                out[order[b]] += self._log_softmax(x[b] @ self.w[c], within[b])
        return out

    @staticmethod
    def _log_softmax(z: np.ndarray, right: np.ndarray) -> np.ndarray:
        """log(softmax(z)) of each row at the right answer; z is overwritten."""
        out = z[np.arange(len(z)), right]
        if z.max() > 60 or z.min() < -80:
            m = z.max(-1)
            z -= m[:, None]
            out -= m
        return out - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))

    def train(self, tokens: np.ndarray, end: int, epochs: int = EPOCHS, rate: float = 0.01, most_lanes: int = LANES) -> Network:
        return self.learn((tokens for _ in range(epochs)), end, epochs * len(tokens), rate, most_lanes)

    def learn(self, chunks: Iterable[np.ndarray], end: int, expected: int, rate: float, most_lanes: int) -> Network:
        """Adam over windows of lanes cut from each chunk, to its last token; the state passes from window to window and is cleared after an end.

        The rate falls with the share of the expected tokens that are read, to a tenth."""
        m1, m2 = ({k: np.zeros_like(getattr(self, k)) for k in "xucw"} for _ in range(2))
        updates = read = 0
        for tokens in chunks:
            if not len(tokens):
                continue
            lanes = min(most_lanes, max(1, len(tokens) // (32 * WINDOW)))
            steps = -(-len(tokens) // (lanes * WINDOW))
            padding = lanes * steps * WINDOW - len(tokens)
            stream = np.concatenate([tokens, np.full(padding, end, tokens.dtype)]).reshape(lanes, -1).T
            counted = np.concatenate([np.ones(len(tokens), np.float32), np.zeros(padding, np.float32)]).reshape(lanes, -1).T
            h = np.zeros((lanes, HIDDEN), np.float32)
            for at in range(0, steps * WINDOW, WINDOW):
                weight = counted[at : at + WINDOW].ravel()
                n = float(weight.sum())
                if not n:
                    break
                h, grads = self._gradients(h, stream[at : at + WINDOW], weight / np.float32(n), end)
                updates, read = updates + 1, read + n
                lr = rate * max(0.1, 1 - read / max(1, expected)) * math.sqrt(1 - 0.999**updates) / (1 - 0.9**updates)
                for k, (rows, g) in grads.items():
                    if rows is None:  # all of them, in parts that stay in the cache
                        parts = (y.ravel() for y in (g, m1[k], m2[k], getattr(self, k)))
                        g, a, b, w = ([y[i : i + _STEP] for i in range(0, len(y), _STEP)] for y in parts)
                        for one in zip(g, a, b, w, strict=True):
                            _adam(*one, lr)
                    else:
                        held = m1[k], m2[k], getattr(self, k)
                        for i in range(0, len(rows), _ROWS_AT_ONCE):
                            some = rows[i : i + _ROWS_AT_ONCE]
                            a, b, w = (y[some] for y in held)
                            _adam(g[i : i + _ROWS_AT_ONCE], a, b, w, lr)
                            for y, value in zip(held, (a, b, w), strict=True):
                                y[some] = value
        return self

    def gradients(self, h: np.ndarray, window: np.ndarray, weight: np.ndarray, end: int) -> tuple[np.ndarray, dict]:
        """(state after the window, for each kind of weights the rows that the window touches and their gradient)."""
        h, grads = self._gradients(h, window, weight, end)
        every, c, w = slice(None), grads["c"][1], grads["w"][1]
        return h, {"x": grads["x"], "u": (every, grads["u"][1]), "wc": (every, c[:-1]), "bc": (every, c[-1]), "ww": (every, w[:, :-1]), "bw": (every, w[:, -1])}

    def _gradients(self, h: np.ndarray, window: np.ndarray, weight: np.ndarray, end: int) -> tuple[np.ndarray, dict]:
        """The same by the arrays that hold the weights; all rows are None. Lanes are columns here, so that gates lie side by side."""
        n, (steps, lanes) = HIDDEN, window.shape
        u = np.ascontiguousarray(_halved(self.u).T)
        live = (window != end).astype(np.float32)
        states, inputs, gates, news = (np.empty((steps, k, lanes), np.float32) for k in (n, n, 2 * n, n))
        h = np.ascontiguousarray(h.T)
        for t in range(steps):
            # Predict the token from h, then read it.
            states[t] = h
            x = np.ascontiguousarray(self.x[window[t]].T)
            x[: 2 * n] *= 0.5
            a, gates[t], news[t], h = _advance(u, x, h)
            inputs[t] = a[2 * n :]
            h *= live[t]
        flat = np.ones((steps * lanes, n + 1), np.float32)
        flat.reshape(steps, lanes, n + 1)[..., :n] = states.transpose(0, 2, 1)
        token = window.ravel()
        g_c, g_w, outer = self._outputs(flat, token, weight)
        outer = np.ascontiguousarray(outer.reshape(steps, lanes, n).transpose(0, 2, 1))
        z, r = gates[:, :n], gates[:, n:]
        by_new = (1 - z) * (1 - news**2)
        by_z = (states - news) * (z * (1 - z))
        by_r = inputs * (r * (1 - r))
        inner, gate = np.empty((steps, 3 * n, lanes), np.float32), np.empty((steps, lanes, 3 * n), np.float32)
        back = np.zeros((n, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            d = back * live[t]
            d_new = d * by_new[t]
            np.multiply(d, by_z[t], out=inner[t, :n])
            np.multiply(d_new, by_r[t], out=inner[t, n : 2 * n])
            np.multiply(d_new, r[t], out=inner[t, 2 * n :])
            gate[t, :, : 2 * n] = inner[t, : 2 * n].T
            gate[t, :, 2 * n :] = d_new.T
            back = self.u @ inner[t]
            d *= z[t]
            back += d
            back += outer[t]
        order = np.argsort(token, kind="stable")
        sorted_tokens = token[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]]))
        g_x = _summed(gate.reshape(-1, 3 * n)[order], first)
        g_u = np.matmul(states, inner.transpose(0, 2, 1)).sum(0)
        return np.ascontiguousarray(h.T), {"x": (sorted_tokens[first], g_x), "u": (None, g_u), "c": (None, g_c), "w": (None, g_w)}

    def _outputs(self, flat: np.ndarray, token: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of both softmaxes' weights, and of the states in flat."""
        cls, within = np.divmod(token, self.classes)
        g_c, g_w, outer = np.zeros_like(self.c), np.zeros_like(self.w), np.empty((len(flat), HIDDEN), np.float32)
        for a in range(0, len(flat), _ROWS_AT_ONCE):
            b = slice(a, a + _ROWS_AT_ONCE)
            e, scale = self._errors(flat[b] @ self.c, cls[b], weight[b])
            g_c += (flat[b] * scale).T @ e
            np.multiply(e @ self.c[:-1].T, scale, out=outer[b])
        order, begin, n = _runs(cls, self.classes)
        for c in np.flatnonzero(n >= _ALONE).tolist():
            for a in range(begin[c], begin[c] + n[c], _ROWS_AT_ONCE):
                rows = order[a : min(a + _ROWS_AT_ONCE, begin[c] + n[c])]
                x = flat[rows]
                e, scale = self._errors(x @ self.w[c], within[rows], weight[rows])
                x *= scale
                g_w[c] += x.T @ e
                outer[rows] += (e @ self.w[c, :-1].T) * scale
        # Few rows of a class meet its weights beside those of other classes; the row behind the last is empty.
        flat, within, weight = np.concatenate([flat, np.zeros((1, HIDDEN + 1), np.float32)]), np.append(within, 0), np.append(weight, np.float32(0))
        for k, rows in _tiles(order, begin, n):
            x, w = flat[rows], self.w[k]
            e, scale = self._errors(np.matmul(x, w).reshape(-1, self.classes), within[rows].ravel(), weight[rows].ravel())
            e, scale = e.reshape(*rows.shape, -1), scale.reshape(*rows.shape, 1)
            x *= scale
            g_w[k] = np.matmul(x.transpose(0, 2, 1), e)
            some = rows >= 0
            outer[rows[some]] += (np.matmul(e, w[:, :-1].transpose(0, 2, 1)) * scale)[some]
        return g_c, g_w, outer

    @staticmethod
    def _errors(z: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(e, scale): e times the scale of its row, in a column, is the row's weighted softmax less the right answer. z is overwritten."""
        if z.max() > 60 or z.min() < -80:
            z -= z.max(-1, keepdims=True)
        e = np.exp(z, out=z)
        total = e @ np.ones(e.shape[1], np.float32)
        e[np.arange(len(e)), right] -= total
        return e, (weight / total)[:, None]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10-probability of every whole token sequence. Those of like length advance together, the shorter ones drop out."""
        out = np.zeros(len(texts))
        order = np.argsort([-len(t) for t in texts], kind="stable")
        u, table = np.ascontiguousarray(_halved(self.u).T), _halved(self.x)
        states, tokens, rows, size = [], [], [], 0

        def add() -> None:
            nonlocal states, tokens, rows, size
            if size:
                p = self.log_probs(np.concatenate(states), np.concatenate(tokens))
                np.add(out, np.bincount(np.concatenate(rows), p, len(out)), out=out)
            states, tokens, rows, size = [], [], [], 0

        for a in range(0, len(order), _TEXTS):
            group = order[a : a + _TEXTS]
            lengths = np.array([len(texts[i]) for i in group])
            starts = np.cumsum(lengths) - lengths
            flat = np.concatenate([texts[i] for i in group]).astype(np.int64)
            # How many are longer than t.
            alive = len(group) - np.cumsum(np.bincount(lengths, minlength=lengths[0] + 1))
            h = np.zeros((HIDDEN, len(group)), np.float32)
            for t in range(lengths[0]):
                live = int(alive[t])
                if live < h.shape[1]:
                    h = np.ascontiguousarray(h[:, :live])
                tok = flat[starts[:live] + t]
                states.append(h.T)
                tokens.append(tok)
                rows.append(group[:live])
                size += live
                h = _advance(u, np.ascontiguousarray(table[tok].T), h)[3]
                if size >= _SORTED:
                    add()
        add()
        return out / math.log(10)


def buckets(words_sorted: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Where the words of each value of their first bits begin among the sorted words, with a bucket for each word or more, and how far to shift for these bits."""
    bits = max(1, len(words_sorted)).bit_length()
    return np.append(np.searchsorted(words_sorted, np.arange(1 << bits, dtype=U) << U(64 - bits)), len(words_sorted)).astype(np.int32), U(64 - bits)


def tokens_of(texts: pa.Array, words_sorted: np.ndarray, begin: tuple[np.ndarray, np.uint64], ids: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, token of each word or `other`, words per text); words_sorted has the known hashes as sorted unsigned numbers, begin their buckets."""
    h, n = words(texts, lower=True)
    out = np.full(len(h), other, ids.dtype)
    key = (h >> begin[1]).astype(np.int64)
    at, last = begin[0][key], begin[0][key + 1]
    live = np.flatnonzero(at < last)
    at, last, h_live = at[live], last[live], h[live]
    while len(live):
        found = words_sorted[at]
        same = found == h_live
        out[live[same]] = ids[at[same]]
        at += 1
        more = (found < h_live) & (at < last)
        live, at, last, h_live = live[more], at[more], last[more], h_live[more]
    return h, out, n


def train_network(docs: DataFrame, vocabulary: Vocabulary, tokens: int) -> Network:
    """A network that learned from every text of docs, which have so many tokens.

    The start's token numbers reach the driver, START_TOKENS at most; after that weights only, summed by ranges of them in tasks."""
    w = np.array(sorted(vocabulary.by_word, key=lambda x: x & (2**64 - 1)), np.int64)
    ids = np.array([vocabulary.by_word[int(x)] for x in w], np.int32)
    w, other, end = w.view(U), vocabulary.other, vocabulary.end
    begin = buckets(w)

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for whole in batches:
            for batch in slices(whole):
                _, tok, n = tokens_of(batch.column("text"), w, begin, ids, other)
                for part in np.split(tok.astype(np.int32), np.cumsum(n)[:-1]):
                    yield np.append(part, np.int32(end))

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = START_TOKENS
        for part in texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part[: max(0, left)].tobytes()], pa.binary())], ["tokens"])
            left -= len(part)

    sample = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(START_DOCS)
    rows = sample.select("text").mapInArrow(start, "tokens binary").collect()
    stream = np.frombuffer(b"".join(bytes(r["tokens"]) for r in rows), np.int32).astype(np.int64)[:START_TOKENS]
    network = Network(vocabulary.counts).train(stream, end)
    parts = max(1, -(-tokens // SHARD))
    expected = tokens // parts

    def go_on(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0

        def chunks() -> Iterator[np.ndarray]:
            nonlocal seen
            held, size = [], 0
            for part in texts(batches):
                for at in range(0, len(part), CHUNK):  # a text longer than a chunk goes on in the next
                    held.append(part[at : at + CHUNK])
                    size += len(held[-1])
                    if size >= CHUNK:
                        seen += size
                        yield np.concatenate(held).astype(np.int64)
                        held, size = [], 0
            seen += size
            if held:
                yield np.concatenate(held).astype(np.int64)

        flat = Network(vocabulary_counts).load(weights).learn(chunks(), end, expected, SHARD_RATE, SHARD_LANES).flat()
        if seen:
            at = range(0, len(flat), _PART)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(at), pa.int64()), pa.array([seen] * len(at), pa.int64()), pa.array([flat[a : a + _PART].tobytes() for a in at], pa.binary())], ["part", "tokens", "weights"]
            )

    weights, vocabulary_counts = network.flat(), vocabulary.counts
    trained = docs.select("text").coalesce(parts).mapInArrow(go_on, _PARTS)
    mean = np.zeros(len(weights))
    learned = 0
    for r in trained.repartition("part").mapInArrow(_mean, _PARTS).toLocalIterator():
        mean[r["part"] : r["part"] + _PART] = np.frombuffer(r["weights"], np.float32)
        learned = r["tokens"]
    network.learned = learned
    return network.load(mean) if learned else network


_PARTS = "part long, tokens long, weights binary"


def _mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the parts of weights that a task gets, by tokens; one row for each part."""
    total: dict[int, np.ndarray] = {}
    tokens: dict[int, int] = {}
    for b in batches:
        for part, n, weights in zip(b.column("part").to_pylist(), b.column("tokens").to_pylist(), b.column("weights").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + n * np.frombuffer(weights, np.float32).astype(np.float64)
            tokens[part] = tokens.get(part, 0) + n
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array(list(tokens.values()), pa.int64()), pa.array([(v / tokens[k]).astype(np.float32).tobytes() for k, v in total.items()], pa.binary())],
        ["part", "tokens", "weights"],
    )


_ROWS = "row long, doc_id long, n_tokens long, known long, heavy double, other double, n_other long, network double, word long, n long"


def score(spark: SparkSession, docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text)."""
    small_batches(spark)
    counts = materialize(spark, word_counts(training), "counts")
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(facts["n"]), int(facts["v"])
    room = classes_for(total) ** 2
    ends = counts.filter(F.col("word") == END_WORD).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"]
    top = counts.orderBy(F.desc("c"), "word").limit(max(HEAVY, room)).toArrow()
    own_words = zip(top.column("word").slice(0, room).to_pylist(), top.column("c").slice(0, room).to_pylist(), strict=True)
    vocabulary = Vocabulary([(END_WORD, ends), *(x for x in own_words if x[0] != END_WORD)], total)
    network = train_network(training, vocabulary, total)

    heavy_words, heavy_counts = top.column("word").to_numpy(), top.column("c").to_numpy()
    own = np.full(len(heavy_words), -1, np.int32)
    for k, w in enumerate(heavy_words[:room].tolist()):
        own[k] = vocabulary.by_word.get(w, -1)
    end_log, end_known = math.log10(ends + 0.5), int(ends > 0)
    order = np.argsort(heavy_words.view(U))
    heavy_words, own, logs = heavy_words.view(U)[order], own[order], np.log10(heavy_counts[order] + 0.5)
    other, end = vocabulary.other, vocabulary.end

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        begin = buckets(heavy_words)
        held: list[tuple[np.ndarray, list]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values = network.score([t for t, _ in held])
            cols = list(zip(*(x for _, x in held), strict=True)) if held else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)] + [pa.array(values, pa.float64()), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _ROWS.split(", ")])

        for whole in batches:
            for batch in slices(whole):
                h, place, n = tokens_of(batch.column("text"), heavy_words, begin, np.arange(len(heavy_words)), -1)
                known = place >= 0
                log = np.where(known, logs[place] if len(logs) else 0.0, 0.0)
                tok = np.where(known, own[place] if len(own) else -1, -1)
                out = tok < 0
                tok[out] = other
                doc = np.repeat(np.arange(len(n)), n)
                rare_doc, rare_word = doc[~known], h[~known]
                if len(rare_doc):  # one row for each text and word
                    o = np.lexsort((rare_word, rare_doc))
                    rare_doc, rare_word = rare_doc[o], rare_word[o]
                    first = np.flatnonzero(np.concatenate([[True], (rare_doc[1:] != rare_doc[:-1]) | (rare_word[1:] != rare_word[:-1])]))
                    times = np.diff(np.append(first, len(rare_doc)))
                    k = len(first)
                    blank = lambda t, k=k: pa.nulls(k, t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row + rare_doc[first]), *(blank(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())), pa.array(rare_word[first].view(np.int64)), pa.array(times)],
                        [x.split()[0] for x in _ROWS.split(", ")],
                    )
                sums = [np.bincount(doc, x, len(n)) for x in (known, log, log * out, out)]
                for i, (part, doc_id) in enumerate(zip(np.split(tok.astype(np.int32), np.cumsum(n)[:-1]), batch.column("doc_id").to_pylist(), strict=True)):
                    held.append((np.append(part, np.int32(end)), [row + i, doc_id, int(n[i]) + 1, int(sums[0][i]) + end_known, sums[1][i] + end_log, sums[2][i], int(sums[3][i])]))
                row += batch.num_rows
                size += int(n.sum())
                if size >= TOKENS:
                    yield flush()
                    held, size = [], 0
        yield flush()

    rows = materialize(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROWS), "scored")
    rare = rows.filter("word is not null").select("row", "word", "n").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    out = rows.filter("word is null").drop("word", "n").join(rare, "row", "left")
    all_words = math.log10(total + 0.5 * (distinct + 1))
    other_words = math.log10(max(0, vocabulary.other_tokens) + 0.5 * (max(0, distinct - vocabulary.size - end_known) + 1))
    rare_sum = F.coalesce("rare", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("heavy") + rare_sum - F.col("n_tokens") * F.lit(all_words)).alias("base_score"), (F.col("network") + F.col("other") + rare_sum - F.col("n_other") * F.lit(other_words)).alias("score"),
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(spark, docs, docs.filter(remainder(5) != 1))
    return out.select("doc_id", F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
