"""Template automata against regular expressions, and the query's columns against a plain scan."""

import random
import re

from quarrygraph.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PART = re.compile(r"\[\[(.*?)\]\]|\{\w+:(\d+)\}|([^\[{]+)", re.S)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pattern(template):
    """The template as a regular expression over words that each end with a space."""
    out = ""
    for optional, hole, plain in PART.findall(template):
        if hole:
            out += f"(?:[^ ]+ ){{0,{hole}}}"
        else:
            words = "".join(re.escape(w) + " " for w in WORD.findall(lower(optional or plain)))
            out += f"(?:{words})?" if optional else words
    return re.compile(out)


def filled(template, r):
    out = []
    for optional, hole, plain in PART.findall(template):
        if hole:
            out += [r.choice(["the", "authors", "X9", "2"]) for _ in range(r.randint(0, int(hole)))]
        elif plain or r.random() < 0.5:
            out += [w.upper() if r.random() < 0.5 else w for w in WORD.findall(lower(plain or optional))]
    return out


def test_every_template_accepts_its_fillings_and_nothing_else():
    r = random.Random(2)
    for label, templates in licenses.TEMPLATES.items():
        for t in templates:
            a, p = licenses.Automaton(t), pattern(t)
            for _ in range(6):
                w = filled(t, r)
                text = " ".join(["before", *w, "after", "that"])
                assert label in licenses.scan(text)["labels"].split(",")
                joined = " ".join(WORD.findall(lower(text))) + " "
                for broken in range(2):
                    if broken:  # a mandatory word is another: what still matches must match the expression too
                        k = r.randrange(len(w))
                        joined = " ".join(["before", *WORD.findall(lower(" ".join([*w[:k], "zzz", *w[k + 1 :]]))), "after", "that"]) + " "
                    words = [x.encode() for x in joined.split()]
                    got = list(a.places(words, b" " + joined.encode()))
                    want = bool(p.search(joined))
                    assert bool(got) == want, (label, t[:40], joined)
                    for start, end in got:
                        assert p.fullmatch("".join(x.decode() + " " for x in words[start:end]))


def test_template_that_begins_with_a_variable_part():
    a = licenses.Automaton("[[This is]] {name:2} under the Foo License")
    words = b"x this is my code under the foo license y".split()
    assert list(a.places(words, b" " + b" ".join(words) + b" ")) == [(1, 9)]


def test_whole_texts():
    mit = next(t for t in licenses.TEMPLATES["mit"] if "NONINFRINGEMENT" in t)
    text = re.sub(r"\{holders:\d+\}", "the authors or copyright holders", mit).replace("{title:3}", "").replace("[[", "").replace("]]", "")
    assert licenses.scan(text)["labels"] == "mit" and licenses.scan(text)["score"] > 0.99
    assert licenses.scan(text.replace("MERCHANTABILITY", "MERCHANTABLENESS"))["score"] < licenses.scan(text)["score"]


def test_query_columns(spark, tmp_path):
    r = random.Random(3)
    parts = ["MIT", "License", "license,", "APACHE\n", "general", "Public", "x9", "Größe", "é", "ermit", "mit-license", "日本", "\x00", "GENERAL PUBLIC LICENSE", "Released under the MIT License."]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(400)] + [None, "", "MIT License " * 20_000]
    path = f"file://{tmp_path}"
    spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1])], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = licenses.op6_license_scan(spark, path).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        w = WORD.findall(lower(texts[1 if x.doc_id is None else x.doc_id] or ""))
        places, labels = [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(x.labels.split(",")) and 0 <= x.score <= 1
