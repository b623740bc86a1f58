"""Second opinions on pending claims from a model that is handed in: what it is shown, what of its answer counts, and where it is kept.

A review never changes an edge's status; it is one more field of it, for the person who decides."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import last
from .graph import EDGE_KEY, queue

# The most characters of a reason and its mark when cut, and the answer's form.
REASON, CUT = 300, " ..."
ANSWER = {
    "type": "object",
    "properties": {"related": {"type": "boolean"}, "reason": {"type": "string"}, "better_match": {"type": ["string", "null"]}},
    "required": ["related", "reason", "better_match"],
}
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


class ReviewError(RuntimeError):
    """The model gave no usable answer; concerns one edge only."""


def conforms(value: object, form: dict, where: str = "answer") -> None:
    """Raise ReviewError unless value has the form: type, required, enum, properties and items of JSON Schema."""
    kinds = form.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def fits(kind: str) -> bool:
        if kind in ("number", "integer"):
            return isinstance(value, (int, float) if kind == "number" else int) and not isinstance(value, bool)
        return isinstance(value, _KINDS[kind])

    if kinds and not any(map(fits, kinds)):
        raise ReviewError(f"{where} is no {' or '.join(kinds)}")
    if "enum" in form and value not in form["enum"]:
        raise ReviewError(f"{where} is none of {form['enum']}")
    if isinstance(value, dict):
        absent = [k for k in form.get("required", []) if k not in value]
        if absent:
            raise ReviewError(f"{where} lacks {', '.join(absent)}")
        for k, part in form.get("properties", {}).items():
            if k in value:
                conforms(value[k], part, f"{where}.{k}")
    if isinstance(value, list) and "items" in form:
        for k, x in enumerate(value):
            conforms(x, form["items"], f"{where}[{k}]")


def sanitized(answer: object, allowed: Iterable[str], most: int = REASON) -> tuple[bool, str, str | None, bool]:
    """(related, reason, better_match, whether a made-up better_match was dropped) of an answer; a name counts only if the run has it."""
    conforms(answer, {"type": "object", "properties": {"related": {"type": "boolean"}, "reason": {"type": "string"}}, "required": ["related", "reason"]})
    reason = answer["reason"].strip()
    if not reason:
        raise ReviewError("answer.reason is empty")
    reason = reason if len(reason) <= most else reason[:most].rstrip() + CUT
    better = answer.get("better_match")
    made_up = better is not None and (not isinstance(better, str) or better not in set(allowed))
    return answer["related"], reason, None if made_up else better, made_up


def names(params: Column, metrics: Column) -> Column:
    """Names that a better match may have."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(F.map_keys(params), empty), F.coalesce(F.map_keys(metrics), empty)))


def skipped_metrics(occurrences: Column) -> Column:
    """Metrics of an edge's occurrences (JSON texts) that aren't the last one's, which alone is reviewed."""
    every = F.transform(occurrences, lambda o: F.get_json_object(o, "$.metric"))
    return F.array_sort(F.array_except(every, F.slice(every, -1, 1)))


def prompt(sentence: Column, printed: Column, metric: Column, value: Column, candidates: Column, title: Column, run: Column, params: Column, metrics: Column) -> Column:
    """What the model is asked about an edge; metrics are shown with six places."""
    shown = F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(metrics, lambda _, v: F.bround(v, 6)))))
    return F.format_string(
        'Claim: "%s"\nPrinted number: %s\nMetric that rounds to it: %s = %s\nCandidates in all: %s\nRun: %s (%s)\nParameters: %s\nMetrics: %s\nAnswer with related, reason and better_match.',
        F.coalesce(sentence, F.lit("")), F.coalesce(printed, F.lit("?")), F.coalesce(metric, F.lit("?")), F.coalesce(value, F.lit("?")), F.coalesce(candidates.cast("string"), F.lit("?")), title, run, F.coalesce(F.to_json(params), F.lit("{}")), F.coalesce(F.to_json(shown), F.lit("{}")),
    )


def pending(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges from claims that wait for a person, in the order of their key."""
    return queue(edges.filter(F.col("type") == "backed_by"), "pending", limit)


_REVIEW = "src string, dst string, type string, extractor string, related boolean, reason string, better_match string, made_up boolean, metric string, metric_value double, model string, error string"
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def review(edges: DataFrame, claims: DataFrame, experiments: DataFrame, complete: Callable[[str], object], model: str, limit: int | None = None) -> DataFrame:
    """A row for each of the first `limit` pending edges: what complete(prompt) said of it, or the error. claims: id, sentence, raw; experiments: id, title, params and metrics (maps). Edges
    carry occurrences (JSON texts). One edge's failure doesn't touch another's."""
    seen = last(F.col("occurrences"))
    asked = pending(edges, limit).select(*EDGE_KEY, F.get_json_object(seen, "$.metric").alias("metric"), F.get_json_object(seen, "$.metric_value").alias("value"), F.get_json_object(seen, "$.claim_raw").alias("raw"), F.get_json_object(seen, "$.candidate_count").alias("candidates"))
    asked = asked.join(claims.select(F.col("id").alias("src"), "sentence", F.col("raw").alias("claim_raw"), F.lit(True).alias("has_claim")), "src", "left")
    asked = asked.join(experiments.select(F.col("id").alias("dst"), "title", "params", "metrics", F.lit(True).alias("has_run")), "dst", "left")
    text = prompt(F.col("sentence"), F.coalesce("raw", "claim_raw"), F.col("metric"), F.col("value"), F.col("candidates"), F.coalesce("title", "dst"), F.col("dst"), F.col("params"), F.col("metrics"))
    ready = F.coalesce(F.col("has_claim") & F.col("has_run"), F.lit(False))
    rows = asked.select(*EDGE_KEY, "metric", F.col("value").try_cast("double").alias("metric_value"), F.when(ready, text).alias("prompt"), names(F.col("params"), F.col("metrics")).alias("allowed"))

    def answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = {k: r[k] for k in (*EDGE_KEY, "metric", "metric_value")} | {"model": model}
                try:
                    if r["prompt"] is None:
                        raise ReviewError("an end of the edge is no node")
                    row |= dict(zip(("related", "reason", "better_match", "made_up"), sanitized(complete(r["prompt"]), r["allowed"] or []), strict=True))
                except Exception as e:  # noqa: BLE001 - whatever the callable raises concerns this edge only
                    row["error"] = str(e) or type(e).__name__
                out.append(row)
            # By the fields' own types: a batch may have nothing in a column.
            yield pa.RecordBatch.from_pylist(out, pa.schema([(k, _TYPES[t]) for k, t in (x.split() for x in _REVIEW.split(", "))]))

    return rows.mapInArrow(answers, _REVIEW)


def annotate(edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """edges with `review`, a JSON text, replaced for the edges that a review without error is about; nothing else changes."""
    said = reviews.filter("error is null").select(*EDGE_KEY, F.to_json(F.struct("related", "reason", "better_match", "model", F.col("dst").alias("run_id"), "metric", "metric_value")).alias("_said"))
    held = F.col("review") if "review" in edges.columns else F.lit(None).cast("string")
    return edges.join(said, EDGE_KEY, "left").withColumn("review", F.coalesce("_said", held)).drop("_said")


def totals(reviews: DataFrame) -> DataFrame:
    """One row: reviewed, written, errors."""
    return reviews.agg(F.count("*").alias("reviewed"), F.coalesce(F.sum(F.col("error").isNull().cast("long")), F.lit(0)).alias("written"), F.count("error").alias("errors"))


def parsed(text: str) -> object:
    """The JSON of a model's text answer."""
    try:
        return json.loads(text)
    except ValueError as e:
        raise ReviewError(f"no JSON: {e}") from e
