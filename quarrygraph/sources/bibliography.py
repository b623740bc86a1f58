"""Bibliographies: the entries of their files, and the references that papers cite, found or not."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_key

# The head of an entry, that of a field, the fields that are kept, and blocks that are no entries.
ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s}]+)\s*,")
FIELD = re.compile(r"(\w+)\s*=\s*")
FIELDS = ["title", "author", "year"]
NO_ENTRIES = ["comment", "string", "preamble"]
SCHEMA = "path string, seq long, key string, entry_type string, title string, author string, year string"
_BRACE = re.compile(r"[{}]")


def closing(text: str, start: int) -> int:
    """Where the brace that was opened just before start closes; one before the end of the text if it never does."""
    depth = 1
    for brace in _BRACE.finditer(text, start):
        depth += 1 if brace[0] == "{" else -1
        if depth == 0:
            return brace.start()
    return len(text) - 1


def value(body: str, start: int) -> tuple[str, int] | None:
    """(a field's value, where the search for the next field goes on): in braces, in quotes, or up to the comma. None if a quote has no end."""
    if body.startswith("{", start):
        end = closing(body, start + 1)
        return body[start + 1 : end], end + 1
    if body.startswith('"', start):
        end = body.find('"', start + 1)
        return None if end < 0 else (body[start + 1 : end], end + 1)
    end = body.find(",", start)
    end = len(body) if end < 0 else end
    return body[start:end], end


def entries(text: str | None) -> Iterator[tuple]:
    """(key, type, title, author, year) of each entry; of a repeated field the first counts. A percent sign starts no comment here."""
    for head in ENTRY.finditer(text or ""):
        if head[1].lower() in NO_ENTRIES:
            continue
        body = text[head.end() : closing(text, text.index("{", head.start()) + 1)]
        kept: dict[str, str] = {}
        at = 0
        while field := FIELD.search(body, at):
            got = value(body, field.end()) if field.end() < len(body) else None
            if got is None:
                break
            kept.setdefault(field[1].lower(), got[0].strip())
            at = got[1]
        yield (head[2], head[1].lower(), *(kept.get(f) for f in FIELDS))


def read(texts: DataFrame) -> DataFrame:
    """(path, seq, key, entry_type, title, author, year) of bibliography files (path, text); seq counts a file's entries. A null text has none."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, n, *e) for p, t in zip(b["path"], b["text"], strict=True) for n, e in enumerate(entries(t))], columns=columns)

    return texts.select("path", "text").mapInPandas(scan, SCHEMA)


def references(found: DataFrame, cited: DataFrame) -> DataFrame:
    """(id, title, entry_type, author, year, bib_file, key, unresolved, spellings): one row for each key of `found` (see read) or of cited
    (target), without regard to case. Of equal keys the last by path and seq counts; `spellings` over 1 tells that such keys collide.
    A key that is only cited is unresolved."""
    last = F.max_by(F.struct("title", "entry_type", "author", "year", F.col("path").alias("bib_file"), "key"), F.struct("path", "seq"))
    known = found.groupBy(normal_key(F.col("key")).alias("_k")).agg(last.alias("r"), F.count_distinct("key").alias("spellings"))
    wanted = cited.select(normal_key(F.col("target")).alias("_k")).filter("_k <> ''").distinct().withColumn("_cited", F.lit(True))
    both = known.join(wanted, "_k", "full_outer")
    shown = [F.col(f"r.{c}").alias(c) for c in ("title", "entry_type", "author", "year", "bib_file")]
    return both.select(F.concat(F.lit("ref:"), "_k").alias("id"), *shown, F.coalesce("r.key", "_k").alias("key"), F.col("r").isNull().alias("unresolved"), F.coalesce("spellings", F.lit(0)).alias("spellings"))
