"""Every stage of the pipeline against a plain version of what it should keep, on its predecessor's rows."""

import collections
import math
import random
import re

from quarrygraph.llm import decontaminate, mixing, quality_rules, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `size` int, copy string, `_row` long, target double"


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def make():
    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [text(n) for n in (20, 60, 200, 5)]
    base = text(120).split()
    texts = [text(r.randint(30, 150)) for _ in range(60)]
    texts += [" ".join(base), " ".join(base), " ".join([*base[:60], "changed", *base[61:]])]
    texts += [f"{text(40)} {x} {text(40)}" for x in items]
    texts += [f"{text(30)} password: {'x9' * 8} {text(30)}", f"{text(30)} AKIA{'Q' * 16} {text(20)}"]
    texts += [None, "", "too short", " ".join(["again and again and then"] * 40), "### $$$ &&& " * 30, text(20_000)]
    rows = [(i, t, "en", None if i % 9 == 4 else f"s{i % 4}", None if t is None else len(t), i, "own", i, 0.5) for i, t in enumerate(texts)]
    return items, rows + [rows[5], (None, text(70), None, None, None, None, None, None, None), (None, f"{text(30)} {items[0]} {text(30)}", None, "s1", 5, None, None, None, None)]


def plain_of(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline

    items, rows = make()
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "mix_sources":
            assert out.columns == docs.columns, name
            out.write.parquet(f"{path}/{name}")
            out = spark.read.parquet(f"{path}/{name}")
        seen[name] = (plain_of(docs.collect()), out.collect())
        docs = out
    before, after = seen["quality_rules"]
    judged = {(r.doc_id, r.text): r.kept for r in quality_rules.judge(spark, spark.createDataFrame(rows, DOCS), ["doc_id", "text"]).collect()}
    assert plain_of(after) == [x for x in before if judged[x]]
    for i, t in before:  # what fails the plain rule goes, ordinary prose stays
        w = WORD.findall(t or "")
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert not (failed and judged[i, t]) and (judged[i, t] or failed or "###" in t)
    before, after = seen["jaccard_join"]
    kept, sets = plain_of(after), [shingles(t) for _, t in before]
    cls = list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                cls = [cls[b] if c == cls[a] else c for c in cls]
    want = [min((x for x, c in zip(before, cls, strict=True) if c == k), key=lambda x: (x[0] is None, x[0] or 0)) for k in sorted(set(cls))]
    assert kept == sorted(want, key=str)
    before, after = seen["decontaminate"]
    has = lambda t: any(f" {' '.join(x.split())} " in f" {' '.join(t.split())} " for x in items)
    assert plain_of(after) == [x for x in before if not has(x[1])] and any(has(t) for _, t in before)
    before, after = seen["secrets"]
    crf = secrets.model()
    assert plain_of(after) == sorted(((i, secrets.redact(t, secrets.scan(t, crf)[1])) for i, t in before), key=str)
    assert not any("x9x9" in r.text or "AKIA" in r.text for r in after) and all(r.n_chars in (None, len(r.text)) for r in after)
    before, after = seen["mix_sources"]
    took = collections.Counter((r.doc_id, r.text) for r in after)
    rate = {(r.doc_id, r.source): r for r in mixing.plan(spark, spark.read.parquet(f"{path}/secrets")).collect()}
    for r in spark.read.parquet(f"{path}/secrets").collect():
        p = rate[r.doc_id, r.source]
        assert took[r.doc_id, r.text] == p.copies and math.floor(p.rate) <= p.copies <= math.ceil(p.rate)
    assert after[0].__fields__ == [*docs.columns] and docs.columns == [*[x.split()[0].strip("`") for x in DOCS.split(", ")], "copy_1"]
    assert decontaminate.find(spark, docs.select("doc_id", "text"), spark.createDataFrame([(0, items[0])], "item_id long, text string")).count() == 0
    total = corpus_pipeline.run(spark, path)
    assert plain_of(total.collect()) == plain_of(after)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    path = f"file://{tmp_path}"
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
