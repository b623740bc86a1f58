"""Which files R scripts and R Markdown documents read and write, found in their token lists, a batch of scripts at a time."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from .scripts import SCHEMA

# Calls that read and write with the place of their path, names of the argument that holds it, and a document's chunks.
READS = {"read.csv": 0, "read_csv": 0, "read_excel": 0, "read_xlsx": 0, "fread": 0, "readRDS": 0, "read_dta": 0}
WRITES = {"write.csv": 1, "write_csv": 1, "fwrite": 1, "saveRDS": 1, "ggsave": 0, "pdf": 0, "png": 0}
PATH_ARGUMENTS = ["file", "path", "filename"]
JOINS = {"paste0": "", "file.path": "/"}
CHUNK, CHUNK_END = re.compile(r"\s*```\{r\b"), re.compile(r"\s*```\s*$")

_TOKEN = re.compile(
    r"""(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<note>\#[^\n]*)|(?P<name>[A-Za-z.][A-Za-z0-9_.]*)|(?P<line>\n)|(?P<sign><<-|<-|->>|->|==|<=|>=|!=|::|\S)""",
    re.S,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Script:
    """The tokens of a script: where each bracket closes, how many parentheses and square brackets are open at each."""

    def __init__(self, text: str):
        self.text = text
        found = (Token(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text))
        self.tokens = [t for t in found if t.kind not in ("note", "line")]
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.ends: dict[int, int] = {}
        self.depth: list[int] = []
        opened: list[int] = []
        depth = 0
        for i, t in enumerate(self.tokens):
            self.depth.append(depth)
            if self.is_sign(i, *_PAIRS):
                opened.append(i)
                depth += t.text != "{"
            elif opened and self.is_sign(i, _PAIRS[self.tokens[opened[-1]].text]):
                depth -= t.text != "}"
                self.ends[opened.pop()] = i

    def is_sign(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "sign" and self.tokens[i].text in texts

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, self.tokens[i].start) + 1

    def arguments(self, opener: int) -> list[range]:
        """The places of each argument's tokens, without empty arguments."""
        out, start, i = [], opener + 1, opener + 1
        while i < self.ends[opener]:
            if self.is_sign(i, ","):
                out.append(range(start, i))
                start = i + 1
            i = self.ends.get(i, i) + 1
        return [r for r in (*out, range(start, self.ends[opener])) if r]

    def literal(self, i: int) -> str | None:
        t = self.tokens[i] if i < len(self.tokens) else None
        return re.sub(r"\\([\\" + t.text[0] + "])", r"\1", t.text[1:-1]) if t and t.kind == "text" else None

    def alone_on_line(self, i: int) -> bool:
        """No other token follows on its line."""
        return i + 1 == len(self.tokens) or "\n" in self.text[self.tokens[i].end : self.tokens[i + 1].start]

    def known(self) -> dict[str, str]:
        """Names that the whole script binds once, by an assignment of a bare text that fills the rest of its line."""
        n: Counter = Counter()
        texts: dict[str, str] = {}
        for i, t in enumerate(self.tokens):
            if self.is_sign(i, "<-", "<<-") or (self.is_sign(i, "=") and self.depth[i] == 0):
                if i and self.tokens[i - 1].kind == "name" and not self.is_sign(i - 2, "$", "@"):
                    name = self.tokens[i - 1].text
                    n[name] += 1
                    if (v := self.literal(i + 1)) is not None and self.line(i) == self.line(i + 1) and self.alone_on_line(i + 1):
                        texts[name] = v
            elif self.is_sign(i, "->", "->>"):
                if i + 1 < len(self.tokens) and self.tokens[i + 1].kind == "name" and not self.is_sign(i + 2, "$", "@", "[", "("):
                    n[self.tokens[i + 1].text] += 1
            elif t.kind == "name" and t.text == "assign" and i + 1 in self.ends:
                first = next(iter(self.arguments(i + 1)), range(0))
                if len(first) == 1 and (v := self.literal(first[0])) is not None:
                    n[v] += 1
        return {k: v for k, v in texts.items() if n[k] == 1}

    def atom(self, places: range, known: dict[str, str]) -> str | None:
        if len(places) != 1:
            return None
        t = self.tokens[places[0]]
        return known.get(t.text) if t.kind == "name" else self.literal(places[0])

    def fold(self, places: range, known: dict[str, str]) -> str | None:
        """The text of a literal, a known name, or a join of those; None for any other expression."""
        head = self.tokens[places[0]]
        if len(places) > 1 and head.kind == "name" and head.text in JOINS and self.ends.get(places[1]) == places[-1]:
            parts = [self.atom(a, known) for a in self.arguments(places[1])]
            return JOINS[head.text].join(parts) if parts and None not in parts else None
        return self.atom(places, known)


def calls(text: str | None) -> list[tuple[int, str, str, str, str | None]]:
    """(line, callee, kind, target, source text if it was folded), as for other scripts. A named path counts before the place of the
    function's own; calls whose path can't be told are left out."""
    s = Script("\n".join((text or "").splitlines()))
    known, out = s.known(), []
    for i, t in enumerate(s.tokens):
        place = READS.get(t.text, WRITES.get(t.text)) if t.kind == "name" else None
        if place is None or i + 1 not in s.ends or not s.is_sign(i + 1, "("):
            continue
        named = {}
        plain = []
        for a in s.arguments(i + 1):
            if len(a) > 1 and s.tokens[a[0]].kind == "name" and s.is_sign(a[1], "="):
                named.setdefault(s.tokens[a[0]].text, a[2:])
            else:
                plain.append(a)
        where = next((v for k, v in named.items() if k in PATH_ARGUMENTS), plain[place] if place < len(plain) else None)
        target = s.fold(where, known) if where else None
        if target is not None:
            package = s.tokens[i - 2].text + "::" if i > 1 and s.is_sign(i - 1, "::") else ""
            source = None if len(where) == 1 and s.tokens[where[0]].kind == "text" else s.text[s.tokens[where[0]].start : s.tokens[where[-1]].end]
            out.append((s.line(i), package + t.text, "reads" if t.text in READS else "writes", target, source))
    return out


def chunks(text: str | None) -> str:
    """An R Markdown document with every line blank that isn't inside an R chunk, so that line numbers stay."""
    out, inside = [], False
    for line in (text or "").splitlines():
        edge = (CHUNK_END if inside else CHUNK).match(line) is not None
        out.append(line if inside and not edge else "")
        inside ^= edge
    return "\n".join(out)


def uses(scripts: DataFrame) -> DataFrame:
    """(path, line_no, callee, kind, target, folded_from) of scripts (path, text); paths that end in .rmd are documents with chunks."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code = ((p, chunks(t) if (p or "").lower().endswith(".rmd") else t) for p, t in zip(b["path"], b["text"], strict=True))
            yield pd.DataFrame([(p, *c) for p, t in code for c in calls(t)], columns=columns)

    return scripts.select("path", "text").mapInPandas(scan, SCHEMA)
