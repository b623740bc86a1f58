"""Decontamination against a plain search: every item at every place of every text."""

import random
import re

import pytest

from quarrygraph.llm import decontaminate

TEXT = "doc_id long, text string, hit string, a long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def plain_hit(item, text):
    """What must be found: nearly all words of the item in order within some stretch of its length, or all of a short one side by side."""
    w, t = WORD.findall(item.lower()), WORD.findall((text or "").lower())
    if not w:
        return False
    if len(w) < decontaminate.SHORT:
        return t == w if len(w) < decontaminate.PHRASE else any(t[i : i + len(w)] == w for i in range(len(t)))
    step = max(1, len(w) // 4)
    return any(plain_lcs(w, t[i : i + len(w) + step]) >= decontaminate.VERBATIM * len(w) for i in range(0, max(1, len(t) - len(w) + step), step))


@pytest.fixture(scope="module")
def tables():
    r = random.Random(5)
    rare = ["".join(r.choice("abcdefgh") for _ in range(r.randint(4, 8))) for _ in range(5_000)]
    common = "der die und in zu den das nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im für".split()
    text = lambda n: " ".join(r.choice(common if r.random() < 0.4 else rare) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 15, 40, 41, 100, 150, 300, 600, 1_000])]
    items += [(50, " ".join(r.choice(common) for _ in range(24))), (51, "Größe ÄNDERT sich nicht, wie 日本 es sieht: ganz und gar"), (52, ""), (53, None), (None, text(30)), (54, items[8][1]), (8, items[8][1])]
    docs = []
    for i, t in items:
        for verb in range(2):
            w = (t or "").split()
            if verb and len(w) > 10:  # every ninth word is another
                w = [r.choice(rare) if k % 9 == 4 else x for k, x in enumerate(w)]
            docs.append((len(docs), f"{text(r.randint(0, 70))} {' '.join(w)} {text(r.randint(0, 70))}"))
    docs += [(900, items[0][1].upper()), (901, items[1][1]), (902, text(1_500) + " " + items[10][1] + " " + text(1_500)), (None, items[9][1]), (903, None), (904, ""), (905, " ".join(common)), (0, docs[0][1]), (910, items[4][1].replace(" ", "\n--")), (911, " ".join(items[4][1].split()[::-1]))]
    return items, docs + [(1_000 + k, text(150)) for k in range(60)]


def test_against_a_plain_search(spark, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 8)  # several blocks
    items, docs = tables
    df = spark.createDataFrame([(*d, "clash", 7) for d in docs], TEXT).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find(spark, df, bench).collect()}
    want = {(d, i) for d, t in docs for i, x in items if x and plain_hit(x, t)}
    assert want <= got, want - got
    # Beyond those only paraphrases may be found: pairs that share at least PARAPHRASE of the item's words.
    text = {d: t for d, t in docs}
    for d, i in got - want:
        assert any(plain_lcs(WORD.findall(x.lower()), WORD.findall(text[d].lower())) >= decontaminate.PARAPHRASE * len(WORD.findall(x.lower())) for j, x in items if j == i and x), (d, i)
    assert not {d for d, _ in got} & set(range(1_000, 1_060))
    monkeypatch.setattr(decontaminate, "GROUP_TERMS", 500)
    monkeypatch.setattr(decontaminate, "ROUND_WORDS", 900)
    monkeypatch.setattr(decontaminate, "CHUNK", 64)
    assert {(x.doc_id, x.item_id) for x in decontaminate.find(spark, df, bench).collect()} >= want


def test_drop_contaminated(spark, tables, tmp_path):
    items, docs = tables
    path = f"file://{tmp_path}"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    df = spark.createDataFrame([(*d, "clash", 7) for d in [*docs, (None, "no item"), (None, "no item"), (None, None)]], TEXT)
    kept = decontaminate.drop_contaminated(spark, df, path)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sum(r.doc_id is None for r in rows) == 3 and {r.text for r in rows if r.doc_id is None} == {"no item", None}
    assert {r.doc_id for r in rows} >= {903, 904, *range(1_000, 1_060)}
    assert not any(plain_hit(x, r.text) for r in rows for _, x in items if x)


def test_only_short_or_no_items(spark, tables):
    _, docs = tables
    df = spark.createDataFrame(docs, "doc_id long, text string")
    find = lambda items: {(x.doc_id, x.item_id) for x in decontaminate.find(spark, df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert find([(1, ""), (2, None)]) == set()
    assert (910, 4) in find([(4, next(t for d, t in docs if d == 910))])
