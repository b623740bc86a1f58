"""Text, path, number and date expressions whose results agree with the usual Unicode-aware rules."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line ends, as text splitting knows them.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\x{2028}\\x{2029}]"


def split_lines(text: Column) -> Column:
    """The lines of text; a line end at the very end starts no further line."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends (trim knows only the blank)."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def slugify(title: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one hyphen; a title without any gets a name from its hash."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.concat(F.lit("section-"), F.substring(F.sha2(strip(title), 256), 1, 8))).otherwise(slug)


def normal_key(key: Column) -> Column:
    return F.lower(strip(key))


def normal_sentence(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, "(?U)\\s+", " ")))


def content_id(*parts: Column) -> Column:
    """The first 16 hex digits of the parts' hash, joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The lower-case extension without its dot, or an empty text."""
    return F.lower(F.regexp_extract(basename(path), "[^.]\\.([^.]+)$", 1))


# File categories by extension.
CATEGORIES = {
    "tex": ["tex"],
    "bib": ["bib"],
    "image": ["png", "jpg", "jpeg", "pdf", "svg", "eps", "gif", "tiff", "tif"],
    "py": ["py"],
    "md": ["md"],
    "r": ["r"],
    "rmd": ["rmd"],
    "data": ["csv", "xlsx", "parquet", "rds", "dta", "json"],
}


def category(path: Column) -> Column:
    """The file's category, null for an unknown extension."""
    ext, out = suffix(path), None
    for name, known in CATEGORIES.items():
        out = F.when(ext.isin(known), name) if out is None else out.when(ext.isin(known), name)
    return out


def norm_path(path: str | None) -> str | None:
    """A relative path in normal form; null if it is empty, absolute or leaves the root."""
    if not path or not path.strip() or path.startswith("/"):
        return None
    out = posixpath.normpath(path)
    return None if out == ".." or out.startswith("../") or out == "." else out


def normal_path(path: Column) -> Column:
    """norm_path as an expression: the steps are folded over a stack, and null once they leave the root."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def step(acc: Column, x: Column) -> Column:
        up = F.struct(F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["inside"] & (F.size(acc["at"]) > 0)).alias("inside"))
        return F.when(x == "..", up).otherwise(F.struct(F.concat(acc["at"], F.array(x)).alias("at"), acc["inside"].alias("inside")))

    end = F.aggregate(steps, start, step)
    return F.when(~path.startswith("/") & end["inside"] & (F.size(end["at"]) > 0), F.array_join(end["at"], "/"))


def natural_key(label: Column) -> tuple[Column, Column]:
    """Sort keys of labels such as 2, 14, 14a: the number in front (none comes last), then the rest."""
    number = F.regexp_extract(label, "^(\\d+)", 1)
    return F.coalesce(F.when(number != "", number.cast("double")), F.lit(float("inf"))), F.regexp_replace(label, "^\\d+", "")


def exact_decimal(value: Column) -> Column:
    """A double's shortest decimal text as a decimal; null for what has none (infinity, NaN, more than 20 digits before the point)."""
    return value.cast("string").try_cast("decimal(38,18)")


def half_up(value: Column, places: Column, known: Iterable[int] = range(19)) -> Column:
    """A decimal rounded half up at each row's number of places, of those known; the scale of round() must be constant."""
    out = None
    for p in known:
        x = F.round(value, p).cast("decimal(38,18)")
        out = F.when(places == p, x) if out is None else out.when(places == p, x)
    return out


def attempt_date(text: Column, year: int | None) -> Column:
    """Dates of hand-kept tables: ISO; with a year also MM-DD, a bound (<= or its sign), and ranges ~DD and ~MM-DD, of which the end counts."""
    t = F.element_at(F.split(strip(text), "(?U)\\s+"), 1)
    iso = F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    if year is None:
        return iso
    bare = F.regexp_replace(t, "^(≤|<=)", "")
    pattern = "^(\\d{2})-(\\d{2})(?:~(?:(\\d{2})-)?(\\d{2}))?$"
    month1, day1, month2, day2 = (F.regexp_extract(bare, pattern, k) for k in range(1, 5))
    month, day = F.when(month2 != "", month2).otherwise(month1), F.when(day2 != "", day2).otherwise(day1)
    start, end = (F.try_to_date(F.concat(F.lit(f"{year}-"), m, F.lit("-"), d), "yyyy-MM-dd") for m, d in ((month1, day1), (month, day)))
    return F.coalesce(iso, F.when(bare.rlike(pattern), F.when(day2 == "", start).when(start.isNotNull() & end.isNotNull(), F.greatest(start, end))))
