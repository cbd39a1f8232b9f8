"""Scalar building blocks, as built-in expressions wherever Spark has them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed value: two-sided 95 per cent point of the normal distribution.
Z95 = 1.959963984540054
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
STATUSES = ("success", "approximate", "unknown", "unsupported_input", "invalid_schema", "parse_error", "inconsistent", "zero_normalizer", "resource_limit", "timeout", "abstained", "non_identified", "unsupported")
PARTITIONS = ("training", "development", "calibration", "final_test", "streaming", "not_applicable")


def valid_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def valid_text(c: Column, most_bytes: int = 4096) -> Column:
    return F.coalesce((F.octet_length(c) > 0) & (F.octet_length(c) <= most_bytes) & ~c.rlike(r"[\x00-\x1F\x7F]"), F.lit(False))


def valid_digest(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def valid_timestamp(c: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` on a real date; second 60 is allowed, year 0 is not."""
    shape = c.rlike(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)Z\z")
    return F.coalesce(shape & F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False)) if hasattr(F, "try_to_date") else F.coalesce(shape & F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def bit_width(c: Column) -> Column:
    return F.when(c == 0, F.lit(0)).otherwise(F.length(F.bin(c.cast("long"))))


def context_key(variables: Column, clauses: Column, literals: Column) -> Column:
    """Bucket sizes by bit width: ``v{}:c{}:l{}``."""
    part = lambda name, c: F.concat(F.lit(name), bit_width(c).cast("string"))
    return F.concat_ws(":", part("v", variables), part("c", clauses), part("l", literals))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Lower and upper 95 per cent Wilson bounds; null for n = 0."""
    p, z2 = successes / n, Z95 * Z95
    middle, spread = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - spread)), F.when(n > 0, F.least(F.lit(1.0), middle + spread))


def entropy(p: Column) -> Column:
    term = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)
    return term(p) + term(1 - p)


def log_loss(p: Column, y: Column) -> Column:
    q = F.when(y, p).otherwise(1 - p)
    return F.when(q > 0, -F.log(q)).otherwise(F.lit(float("inf")))


def prediction_set(p: Column, threshold: Column) -> Column:
    """Labels 0 and 1 whose score 1 - probability is within the threshold."""
    return F.concat(F.when(p <= threshold, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(1 - p <= threshold, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))


def parse_prompt(c: Column) -> Column:
    """struct(subject, relation) of ``subject [SEP] relation``; null unless both parts are there."""
    parts = F.transform(F.split(c, r"\[SEP\]"), lambda x: F.trim(x))
    ok = (F.size(parts) == 2) & (F.get(parts, 0) != "") & (F.get(parts, 1) != "")
    return F.when(ok, F.struct(F.get(parts, 0).alias("subject"), F.get(parts, 1).alias("relation")))


def format_duration(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def causal_policy(interventional: Column, graph: Column, positivity: Column, ignorability: Column, estimator: Column) -> Column:
    """Only observational requests are answered here; others say what is missing."""
    return F.when(~interventional, "success").when(~graph | ~positivity | ~ignorability, "non_identified").otherwise("unsupported_input")


def _normalize(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(StringType())
def normalize_text(values: pd.Series) -> pd.Series:
    """NFKC, case folding and single spaces; Spark has no built-in for the first two."""
    return values.map(lambda v: None if v is None else _normalize(v))


@F.pandas_udf(ArrayType(StringType()))
def _first_surfaces(values: pd.Series) -> pd.Series:
    def first(surfaces):
        kept: dict[str, str] = {}
        for v in surfaces:
            if v is not None and (key := _normalize(v)):
                kept.setdefault(key, v.strip())
        return list(kept.values())
    return values.map(first)


def subject_surfaces(prompt: Column, *lists: Column) -> Column:
    """The prompt's subject, then the surfaces of ``lists`` in order; of equal normalised ones the first."""
    return _first_surfaces(F.concat(F.array(parse_prompt(prompt)["subject"]), *[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
