"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, jaccard_join, language_model, licenses, mixing, quality_classifier, quality_rules, secrets, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_language_model": language_model.op10_language_model,
        "op1_jaccard_join": jaccard_join.op1_jaccard_join,
        "op4_html_extract": html_extract.op4_html_extract,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op2_warc": warc.op2_warc,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    }


def oracles() -> dict[str, str]:
    return {"op2_warc": warc.SQL, "op3_mix_sources": mixing.SQL}
