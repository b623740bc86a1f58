"""Benchmark decontamination: latent semantic retrieval of benchmark passages in documents, then checks word by word.

The stated query set, the benchmark, is searched against all documents:

1. Terms are the words of all items. One pass over the texts replaces each word by its place and its term's number, drops
   words of no item, and counts in how many half-passages (HALF words) each term stands. Later steps read numbers only.
   (A benchmark of over ROUND_WORDS words is taken in rounds of so many, as each task holds a round's terms.)
2. Items form blocks of ITEMS. A block's matrix has a row of TF-IDF weights for every document passage (two
   neighbouring halves) and for every item. Its leading right singular vectors come from a randomised range finder:
   tasks sum A'(A O) for a random O over their own rows, and the sums are added up by ranges. All blocks
   whose terms together are under GROUP_TERMS share these passes.
3. A passage is a candidate for an item if their vectors in the latent space are near by cosine and
   the passage covers enough of the item, or of one of the windows, no longer than a passage, that a longer item is cut into.
4. Around a candidate, the longest common subsequence of item and document decides: nearly all of an
   item's words in order is a hit; fewer are one if the item's weighty words are there and its
   answer (the words of its last part) is too.

Terms that stand in over COMMON of all half-passages are left out of the search (never of the comparison), but only as far
as each item keeps KEEP of its weight; an item made of such terms is searched by them.

Defined cases: an item of fewer than SHORT words matches where its words stand side by side, one of fewer than PHRASE words only a
text that has no other words; null and empty texts and items match nothing; rows without an id are searched like others, and
their pairs carry the null id; repeated rows and repeated items give one pair; further columns are ignored;
with an empty table there is no hit. A text of any length is searched whole, in chunks of CHUNK passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns, materialize, read_table, slices, small_batches
from .textvec import ALNUM, U, mix, words

#: Items of a block; terms that the blocks of one pass have together, or one block, if it alone has more; words of a round.
ITEMS, GROUP_TERMS, ROUND_WORDS = 512, 65_536, 4_000_000
RANK, OVERSAMPLE = 192, 16
#: Words of half a passage, and passages that a task projects together.
HALF, CHUNK = 20, 4_096
#: Items of fewer words than SHORT are matched word for word, and those of fewer than PHRASE against whole texts.
SHORT, PHRASE = 8, 3
COMMON, KEEP = 0.1, 0.7
#: Terms with more than this share are multiplied as a dense matrix, others row by row; the sums are the same.
DENSE = 0.02
#: Cosine in the latent space, and share of the item's weight that the passage must cover, for a candidate.
COSINE, COVER = 0.2, 0.3
#: Shares of the item's words in the common subsequence: for a hit, and for a paraphrase whose answer stands.
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.55, 0.6
#: Numbers of a row in the sum of sketches.
_PART = 8_192


class Items:
    """The items of a round as numbers of their terms."""

    def __init__(self, items: list[tuple[int | None, str]]):
        hashes, counts = words(pc.utf8_lower(pa.array([t for _, t in items], pa.string())), ALNUM, lower=True)
        self.terms, numbers = np.unique(hashes, return_inverse=True)
        self.ids = [i for i, _ in items]
        self.words = np.split(numbers.astype(np.int32), np.cumsum(counts)[:-1])
        #: Items that are matched word for word: by number of words, the hash of the words and who has it.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < SHORT:
                self.short.setdefault(len(w), {}).setdefault(int(_runs(w, len(w))[0]), []).append(k)
        self.long = [k for k, w in enumerate(self.words) if len(w) >= SHORT]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words of no item."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1).astype(np.int32)


def _runs(term: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring terms."""
    out = np.zeros(max(0, len(term) - n + 1), U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * U(0x9E3779B97F4A7C15) + term[k : k + len(out)].astype(U) + U(1))
    return out


class Block:
    """Some items with the columns of their terms, the commonest first, and their weights."""

    def __init__(self, items: Items, members: list[int], share: np.ndarray, idf: np.ndarray):
        self.members = np.array(members, np.int64)
        every = [items.words[k] for k in members]
        terms = np.unique(np.concatenate(every))
        kept = share <= COMMON
        for w in every:
            missing = KEEP * idf[w].sum() - idf[w[kept[w]]].sum()
            if missing > 0:  # the rarest of its common terms come back
                back = np.unique(w[~kept[w]])
                back = back[np.argsort(share[back], kind="stable")]
                gained = np.cumsum(idf[back] * (w[:, None] == back).sum(0))
                kept[back[: np.searchsorted(gained, missing) + 1]] = True
        terms = terms[kept[terms]]
        self.terms = terms[np.argsort(-share[terms], kind="stable")]
        self.weight = idf[self.terms].astype(np.float32)
        self.dense = int((share[self.terms] >= DENSE).sum())
        place = np.full(len(items.terms), -1, np.int32)
        place[self.terms] = np.arange(len(self.terms))
        self.words = [(c := place[w])[c >= 0] for w in every]
        parts = [(k, place[p]) for k, w in enumerate(every) if len(w) > 2 * HALF for p in np.array_split(w, -(-len(w) // (2 * HALF)))]
        #: (item, columns) of each window of the items that are longer than a passage.
        self.windows = [(k, p[p >= 0]) for k, p in parts if (p >= 0).any()]
        self.size = (len(self.terms), min(RANK + OVERSAMPLE, len(self.terms)))

    def omega(self) -> np.ndarray:
        return np.linalg.qr(np.random.default_rng(17).normal(size=self.size))[0].astype(np.float32)

    def columns(self, terms: int) -> np.ndarray:
        """Column by term number, -1 for terms that the search leaves out."""
        out = np.full(terms, -1, np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def project(self, sketch: np.ndarray, passages: int) -> None:
        """The basis from sketch = A'(A omega), A being the document passages, with the items' rows given an equal share."""
        omega = self.omega()
        scaled = self.weight[:, None] * omega
        y = sketch.astype(np.float64)
        share = max(1.0, passages / len(self.members))
        for w in self.words:
            np.add.at(y, w, share * self.weight[w, None] * scaled[w].sum(0))
        # Nystrom: A'A is about y (omega' y)^-1 y', shifted a little to stay positive.
        y += 1e-6 * np.linalg.norm(y) * omega
        c = omega.T @ y
        values, vectors = np.linalg.eigh((c + c.T) / 2)
        good = values > 1e-10 * max(values.max(), 1e-30)
        u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        self.weighted = self.weight[:, None] * u[:, :RANK].astype(np.float32)
        # Rows of the search: every item as a whole, then the windows.
        self.owner = np.array([*range(len(self.words)), *(k for k, _ in self.windows)], np.int64)
        self.vectors = np.array([self.weighted[w].sum(0) for w in [*self.words, *(p for _, p in self.windows)]], np.float32)
        self.energy = (self.vectors**2).sum(1)


_NUMBERS = "doc_id long, a long, b long, n long, place binary, term binary, counted long"


def _batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in _NUMBERS.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(rows, kinds[k])) for n, k in fields], [n for n, _ in fields])


def _pack(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, numbers per row) of a column that `_pack` made."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
    off = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(np.int32), np.diff(off) // 4


def _number_texts(items: Items):
    """Places and terms of every text that has any, and, in rows of their own, the half-passages with each term; `counted` -1 stands for all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, halves = np.zeros(len(items.terms), np.int64), 0
        for whole in batches:
            for batch in slices(whole):
                h, n = words(pc.utf8_lower(batch.column("text")), ALNUM, lower=True)
                number = items.number(h)
                inside = np.flatnonzero(number >= 0)
                doc = np.repeat(np.arange(len(n)), n)[inside]
                place, term = inside - (np.cumsum(n) - n)[doc], number[inside]
                many = -(-n // HALF)
                halves += int(many.sum())
                pair = np.unique(((np.cumsum(many) - many)[doc] + place // HALF) * len(items.terms) + term)
                found += np.bincount(pair % len(items.terms), minlength=len(items.terms))
                counts = np.bincount(doc, minlength=len(n))
                some = pa.array(counts > 0)
                yield _batch(
                    batch.num_rows, doc_id=batch.column("doc_id"), a=batch.column("a"), b=batch.column("b"), n=pa.array(n.astype(np.int64)), place=_pack(place, counts), term=_pack(term, counts)
                ).filter(some)
        at = np.flatnonzero(found)
        yield _batch(len(at) + 1, n=pa.array(np.append(found[at], halves)), counted=pa.array(np.append(at, -1)))

    return run


class Texts:
    """A batch of numbered texts: for each term that stands, in order, its text, place, half-passage and number; and all passages."""

    def __init__(self, batch: pa.RecordBatch):
        self.place, counts = _unpack(batch.column("place"))
        self.term, _ = _unpack(batch.column("term"))
        self.n = batch.column("n").to_numpy()
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        many = -(-self.n // HALF)
        first = np.cumsum(many) - many
        self.half = first[self.doc] + self.place // HALF
        # A passage is two neighbouring halves, or the only one.
        passages = np.maximum(many - 1, 1)
        self.owner = np.repeat(np.arange(len(many)), passages)
        self.nth = np.arange(len(self.owner)) - np.repeat(np.cumsum(passages) - passages, passages)
        self.first = first[self.owner] + self.nth
        self.last = np.where(many[self.owner] > 1, self.first + 1, self.first)

    def chunks(self) -> Iterator[tuple[slice, slice, int]]:
        """(passages, terms that stand in them, first half) of at most CHUNK passages."""
        for at in range(0, len(self.owner), CHUNK):
            part = slice(at, min(at + CHUNK, len(self.owner)))
            a, b = np.searchsorted(self.half, [self.first[part.start], self.last[part.stop - 1] + 1])
            if b > a:
                yield part, slice(int(a), int(b)), int(self.first[part.start])


def _add_rows(out: np.ndarray, at: np.ndarray, values: np.ndarray, row: np.ndarray) -> None:
    """out[at] += values[row], at being sorted: first the first row of each place, then the second, so that no place comes twice at once."""
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(at)))
    while len(first):
        out[at[first]] += values[row[first]]
        more = many > 1
        first, many = first[more] + 1, many[more] - 1


class _Product:
    """The term counts of some half-passages as a matrix: dense columns first, the others row by row."""

    def __init__(self, half: np.ndarray, column: np.ndarray, halves: int, dense: int):
        d = column < dense
        self.halves, self.dense = halves, dense
        self.counts = np.bincount(half[d] * dense + column[d], minlength=halves * dense).astype(np.float32).reshape(halves, dense) if dense else None
        self.half, self.column = half[~d], column[~d]

    def times(self, table: np.ndarray) -> np.ndarray:
        out = self.counts @ table[: self.dense] if self.dense else np.zeros((self.halves, table.shape[1]), np.float32)
        _add_rows(out, self.half, table, self.column)
        return out

    def add_transposed(self, values: np.ndarray, total: np.ndarray) -> None:
        """total += counts' values."""
        if self.dense:
            total[: self.dense] += self.counts.T @ values
        order = np.argsort(self.column, kind="stable")
        _add_rows(total, self.column[order], values, self.half[order])


def _products(blocks: list[Block], columns: list[np.ndarray], batch: pa.RecordBatch) -> Iterator[tuple]:
    """(texts, passages, number of the block, block, counts, first and last halves of the passages) for every chunk and block."""
    texts = Texts(batch)
    for part, stand, low in texts.chunks():
        halves = int(texts.last[part.stop - 1]) + 1 - low
        first, last = texts.first[part] - low, texts.last[part] - low
        for k, block in enumerate(blocks):
            column = columns[k][texts.term[stand]]
            some = column >= 0
            if some.any():
                yield texts, part, k, block, _Product(texts.half[stand][some] - low, column[some], halves, block.dense), first, last


def _sketch(blocks: list[Block], terms: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [b.columns(terms) for b in blocks]
        scaled = [b.weight[:, None] * b.omega() for b in blocks]
        total = [np.zeros(b.size, np.float32) for b in blocks]
        for batch in batches:
            for _, _, k, _, product, first, last in _products(blocks, columns, batch):
                sums = product.times(scaled[k])
                two = last != first
                seen = sums[first]
                seen[two] += sums[last[two]]
                # A' y: each half gives its terms the values of the passages that it lies in; no half is first, or last, of two.
                back = np.zeros_like(sums)
                back[first] += seen
                back[last[two]] += seen[two]
                product.add_transposed(back, total[k])
        flat = np.concatenate([(b.weight[:, None] * t).ravel() for b, t in zip(blocks, total, strict=True)])
        parts = range(0, len(flat), _PART)
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([flat[a : a + _PART].tobytes() for a in parts], pa.binary())], ["part", "sums"])

    return run


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts that a task gets, one row for each part."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, sums in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(sums, np.float32)
            total[part] = total[part] + x if part in total else x.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], ["part", "sums"])


def lcs(item: np.ndarray, doc: np.ndarray) -> int:
    """Length of the longest common subsequence, 64 item words to a machine word and more (bit-parallel)."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in doc.tolist():
        m = places.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def verify(item: np.ndarray, region: np.ndarray, idf: np.ndarray, flags: np.ndarray) -> tuple[float, float, float] | None:
    """(common words, weight covered, answer covered) as shares of the item, if the terms of region have the item. flags: false for each term."""
    flags[region] = True
    present = flags[item]
    flags[region] = False
    if present.mean() < PARAPHRASE:  # the common subsequence can't be longer
        return None
    common = lcs(item, region) / len(item)
    if common < PARAPHRASE:
        return None
    weight = float(idf[item[present]].sum() / idf[item].sum())
    answer = float(present[-max(3, len(item) // 4) :].mean())
    return (common, weight, answer) if common >= VERBATIM or (weight >= ANSWER and answer >= ANSWER) else None


def _word_for_word(items: Items, texts: Texts) -> Iterator[tuple[int, int]]:
    """(text, item) where all words of a short item stand side by side."""
    for n, known in items.short.items():
        key = _runs(texts.term, n)
        a, b = np.arange(len(key)), np.arange(len(key)) + n - 1
        good = (texts.doc[a] == texts.doc[b]) & (texts.place[b] - texts.place[a] == n - 1)
        if n < PHRASE:
            good &= texts.n[texts.doc[a]] == n
        good[good] = np.isin(key[good], np.array(list(known), U))
        for at in np.flatnonzero(good):
            yield from ((int(texts.doc[at]), k) for k in known[int(key[at])])


_HITS = "doc_id long, a long, b long, item_id long, common double, weight double, answer double"
_HIT_TYPES = [pa.int64()] * 4 + [pa.float64()] * 3


def _search(items: Items, blocks: list[Block], idf: np.ndarray, short: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, flags = [b.columns(len(items.terms)) for b in blocks], np.zeros(len(items.terms), bool)
        for batch in batches:
            hits: dict[tuple[int, int], tuple] = {}
            if short:
                hits |= {x: (1.0, 1.0, 1.0) for x in _word_for_word(items, Texts(batch))}
            for texts, part, _, block, product, first, last in _products(blocks, columns, batch):
                needed, long = COVER * block.energy, np.sqrt(block.energy)
                v = product.times(block.weighted)
                two = last != first
                passage = v[first]
                passage[two] += v[last[two]]
                size = np.sqrt((passage**2).sum(1))
                rows = np.flatnonzero(size >= float((needed / np.maximum(long, 1e-9)).min()))  # none shorter can cover enough of any item
                dot = passage[rows] @ block.vectors.T
                r, k = np.nonzero(dot >= needed[None, :])
                near = dot[r, k] >= COSINE * size[rows[r]] * long[k]
                r, k = r[near], k[near]
                for k, p in sorted(set(zip(block.owner[k].tolist(), (part.start + rows[r]).tolist(), strict=True))):
                    d, item = int(texts.owner[p]), int(block.members[k])
                    if (d, item) in hits:
                        continue
                    w, at, a, b = items.words[item], HALF * int(texts.nth[p]), texts.start[d], texts.end[d]
                    x, y = np.searchsorted(texts.place[a:b], [at - len(w), at + 2 * HALF + len(w)])
                    found = verify(w, texts.term[a + x : a + y], idf, flags)
                    if found:
                        hits[d, item] = found
            names = [batch.column(c).to_pylist() for c in ("doc_id", "a", "b")]
            rows = [(*(c[d] for c in names), items.ids[k], *found) for (d, k), found in hits.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(_HIT_TYPES)], [x.split()[0] for x in _HITS.split(", ")])

    return run


def _rounds(benchmark: DataFrame) -> Iterator[Items]:
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"].split())
        if size >= ROUND_WORDS:
            yield Items(held)
            held, size = [], 0
    if held:
        yield Items(held)


def _text_name() -> tuple:
    """Two numbers that name a text."""
    return F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b")


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, the numbers a and b that name the text, item_id and the shares that decided, for every text with an item of the benchmark."""
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_name(), "text").filter("text is not null")
    out = spark.createDataFrame([], _HITS)
    for items in _rounds(benchmark):
        if len(items.terms):
            out = out.union(_find_round(spark, docs, items))
    return out


def _find_round(spark: SparkSession, docs: DataFrame, items: Items) -> DataFrame:
    numbers = materialize(spark, docs.mapInArrow(_number_texts(items), _NUMBERS), "numbers")
    counts = {r["counted"]: r["n"] for r in numbers.filter("counted is not null").groupBy("counted").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the round
    halves = counts.pop(-1, 0)
    n = np.zeros(len(items.terms), np.int64)
    n[list(counts)] = list(counts.values())
    share, idf = n / max(1, halves), np.log1p((halves + 1) / (n + 1)).astype(np.float32)
    texts = numbers.filter("counted is null").select("doc_id", "a", "b", "n", "place", "term")
    blocks = [Block(items, items.long[a : a + ITEMS], share, idf) for a in range(0, len(items.long), ITEMS)]
    groups: list[list[Block]] = [[]]
    for b in blocks:
        if groups[-1] and sum(len(x.terms) for x in groups[-1]) + len(b.terms) > GROUP_TERMS:
            groups.append([])
        groups[-1].append(b)
    out = None
    for k, group in enumerate(groups):
        if group:
            sizes = [b.size[0] * b.size[1] for b in group]
            flat = np.zeros(sum(sizes), np.float32)
            parts = texts.mapInArrow(_sketch(group, len(items.terms)), "part long, sums binary")
            for r in parts.repartition("part").mapInArrow(_add, "part long, sums binary").toLocalIterator():
                x = np.frombuffer(r["sums"], np.float32)
                flat[r["part"] : r["part"] + len(x)] = x
            for b, sketch in zip(group, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                b.project(sketch.reshape(b.size), halves)
        found = texts.mapInArrow(_search(items, group, idf, k == 0 and bool(items.short)), _HITS)
        out = found if out is None else out.union(found)
    return out


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) with the shares that decided, for every document that has an item of the benchmark."""
    return hits(spark, docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("common").alias("common"), F.max("weight").alias("weight"), F.max("answer").alias("answer"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any item of the benchmark, told by their texts: rows without an id are judged too, repeated rows
    alike, and a null or empty text stays. Columns may have any names."""
    found = materialize(spark, hits(spark, docs, read_table(spark, sf_dir, "benchmark")).select(F.col("a").alias("_hit_a"), F.col("b").alias("_hit_b")).distinct(), "contaminated")
    a, b = _text_name()
    side = broadcast_if_small(found, found.count())
    return docs.join(side, (a == F.col("_hit_a")) & (b == F.col("_hit_b")), "left_anti").select(*columns(docs))
