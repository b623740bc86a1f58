"""A repository's history and files, read by its own command line on the driver and written where executors can read it."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category
from . import history


class GitError(RuntimeError):
    """The command failed."""


class NotARepository(GitError):
    """The folder is in no repository; a scan can go on without history."""


def _run(root: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True)
    except OSError as e:
        raise GitError(str(e)) from e
    if done.returncode:
        said = done.stderr.decode("utf-8", "replace").strip()
        raise (NotARepository if "not a git repository" in said.lower() else GitError)(said)
    return done.stdout.decode("utf-8", "surrogateescape")


def readable(name: str) -> bool:
    """Whether a file name is text; one with bytes of another encoding can be no key."""
    return not any(0xDC80 <= ord(c) <= 0xDCFF for c in name)


def head(root: str) -> str | None:
    """The current commit; None before the first one."""
    try:
        return _run(root, "rev-parse", "--verify", "HEAD").strip()
    except NotARepository:
        raise
    except GitError:
        return None


def log(spark: SparkSession, root: str) -> DataFrame:
    """`history.commits` of the repository, oldest first; no rows before the first commit."""
    text = _run(root, "log", "--reverse", "-z", "--name-only", f"--format={history.LOG_FORMAT}") if head(root) else ""
    clean = "".join(c if not 0xD800 <= ord(c) <= 0xDFFF else "�" for c in text)
    found = history.commits(spark.createDataFrame([(root, clean)], "path string, text string"))
    return found.withColumn("files", F.filter("files", lambda x: ~F.contains(x, F.lit("�"))))


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """(path, category) of the tracked files of a known category, their names exactly as they are."""
    names = [(n,) for n in _run(root, "ls-files", "-z").split("\0") if n and readable(n)]
    return spark.createDataFrame(names, "path string").withColumn("category", category(F.col("path"))).filter("category is not null")


def blame(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """`history.blame` of some files, each read once; files without history give no lines."""
    texts = []
    for name in files:
        try:
            out = _run(root, "blame", "--porcelain", "--", name)
        except NotARepository:
            raise
        except GitError:
            continue
        texts.append((name, out.encode("utf-8", "replace").decode()))
    return history.blame(spark.createDataFrame(texts, "file string, text string"))
