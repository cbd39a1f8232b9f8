"""Canonical JSON: sorted keys, integers only, minimal escapes, strict on the way in."""

from __future__ import annotations

import json
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MOST_BYTES, MOST_DEPTH, MOST_NODES = 16 << 20, 64, 1_000_000
LEAST, MOST = -(1 << 63), (1 << 64) - 1


class NotCanonical(ValueError):
    pass


def encode(value) -> str:
    """Text of null, bool, 64-bit integers, strings, arrays and objects; keys in byte order."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, int):
        if not LEAST <= value <= MOST:
            raise NotCanonical("integer range")
        return str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(encode, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{encode(k)}:{encode(value[k])}" for k in sorted(value, key=lambda k: k.encode())) + "}"
    raise NotCanonical(type(value).__name__)


def decode(text: str):
    """The value of canonical text; anything that would encode differently raises."""
    if len(text.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        raise NotCanonical("size")

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) < len(keys):
            raise NotCanonical("repeated key")
        return dict(items)

    def no(token):
        raise NotCanonical(f"number {token}")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_float=no, parse_constant=no)
    except (json.JSONDecodeError, RecursionError) as e:
        raise NotCanonical(str(e)) from e
    stack, nodes = [(value, 1)], 0
    while stack:
        v, depth = stack.pop()
        nodes += 1
        if nodes > MOST_NODES or depth > MOST_DEPTH:
            raise NotCanonical("limits")
        stack += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    if encode(value) != text:
        raise NotCanonical("not in canonical form")
    return value


def rational_to_json(value: Fraction) -> dict:
    return {"$rational": [str(value.numerator), str(value.denominator)]}


def rational_from_json(value) -> Fraction:
    """Reduced, positive denominator, canonical digits; NotCanonical otherwise."""
    if not isinstance(value, dict) or list(value) != ["$rational"] or not isinstance(value["$rational"], list) or len(value["$rational"]) != 2:
        raise NotCanonical("rational")
    n, d = value["$rational"]
    if not (isinstance(n, str) and isinstance(d, str) and re.fullmatch(r"0|-?[1-9][0-9]*", n) and re.fullmatch(r"[1-9][0-9]*", d)):
        raise NotCanonical("rational digits")
    got = Fraction(int(n), int(d))
    if (str(got.numerator), str(got.denominator)) != (n, d):
        raise NotCanonical("not reduced")
    return got


@F.pandas_udf(StructType([StructField("status", StringType()), StructField("diagnostic", StringType())]))
def check_canonical(texts: pd.Series) -> pd.DataFrame:
    """struct(status, diagnostic) of each text."""
    rows = []
    for t in texts:
        try:
            decode(t or "")
            rows.append(("success", None))
        except NotCanonical as e:
            rows.append(("parse_error", str(e)))
    return pd.DataFrame(rows, columns=["status", "diagnostic"])
