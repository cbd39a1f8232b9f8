"""Archives of formulas and JSON lines as DataFrames."""

from __future__ import annotations

import hashlib
import io
import lzma
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.sources.dimacs import parse

MEMBER = "archive string, member string, n_bytes long, sha256 string, text string, status string"


def archive_members(spark: SparkSession, path: str, most_bytes: int = (2 << 30) - 1) -> DataFrame:
    """One row per file of the tar archives at ``path``; ``.xz`` members are unpacked.

    A member over ``most_bytes`` (by default what one value of Spark can hold)
    keeps its row with status resource_limit and no text.
    """

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(bytes(content))) as tar:
                    for m in tar:
                        if not m.isfile():
                            continue
                        data = tar.extractfile(m).read() if m.size <= most_bytes else None
                        if data is not None and m.name.endswith(".xz"):
                            unpacker = lzma.LZMADecompressor()
                            data = unpacker.decompress(data, most_bytes)
                            data = data if unpacker.eof else None
                        row = (name, m.name, len(data) if data is not None else None, hashlib.sha256(data).hexdigest() if data is not None else None, data.decode("utf-8", "replace") if data is not None else None, "success" if data is not None else "resource_limit")
                        yield pd.DataFrame([row], columns=[c.split()[0] for c in MEMBER.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MEMBER)


STATS = "formula_id string, status string, variables long, clauses long, literals long, units long, longest long, weighted long, canonical string, sources array<string>, clause_hashes array<string>"


def audit_formulas(formulas: DataFrame) -> DataFrame:
    """formulas: formula_id, text.  Structure, provenance and an order-free digest of each formula."""
    names = [c.split()[0] for c in STATS.split(", ")]

    def run(frames):
        for frame in frames:
            out = []
            for i, text in zip(frame["formula_id"], frame["text"], strict=True):
                try:
                    f = parse(text)
                except ValueError as e:
                    out.append((i, getattr(e, "status", "parse_error"), *[None] * 9))
                    continue
                hashes = sorted({hashlib.sha256(" ".join(map(str, sorted(c))).encode()).hexdigest()[:32] for c in f.clauses})
                weights = [f"{v}:{a}:{b}" for v, (a, b) in sorted(f.weights.items())]
                digest = hashlib.sha256("\n".join([str(f.variables), *hashes, *weights]).encode()).hexdigest()
                sources = [" ".join(line.split()[2:]) for line in text.split("\n") if line.split()[:2] == ["c", "r"]]
                out.append((i, "success", f.variables, len(f.clauses), sum(map(len, f.clauses)), sum(len(c) == 1 for c in f.clauses), max(map(len, f.clauses), default=0), len(f.weights), digest, sources, hashes))
            yield pd.DataFrame(out, columns=names)

    return formulas.select("formula_id", "text").mapInPandas(run, STATS)


def audit_rollup(stats: DataFrame) -> DataFrame:
    """One row over the formulas of ``audit_formulas``: counts by outcome, sums, extremes and means of the structure, provenance, copies."""
    ok = F.col("status") == "success"
    sums = [F.sum(c).alias(n) for c, n in (("variables", "variables"), ("clauses", "clauses"), ("literals", "literals"), ("units", "units"), ("weighted", "weighted_variables"))]
    ends = [f(c).alias(f"{n}_{c}") for f, n in ((F.min, "least"), (F.max, "greatest")) for c in ("variables", "clauses", "literals")]
    return stats.agg(
        F.count("*").alias("formulas"), F.count_if(ok).alias("parsed"), F.count_if(F.col("status") == "parse_error").alias("parse_errors"), F.count_if(F.col("status") == "unsupported_input").alias("unsupported"), *sums, *ends,
        F.max("longest").alias("longest"), F.count_if(F.col("weighted") > 0).alias("weighted"), F.count_if(F.col("weighted") == F.col("variables")).alias("fully_weighted"), F.count_if(F.col("units") > 0).alias("with_units"),
        F.count_if(F.col("clauses") == 0).alias("without_clauses"), F.count_if(F.col("longest") <= 2).alias("binary"), F.count_if(F.size("sources") > 0).alias("with_sources"), F.sum(F.when(ok, F.size("sources"))).alias("sources"),
        F.count_if(F.size("clause_hashes") < F.col("clauses")).alias("with_repeated_clauses"), F.countDistinct("canonical").alias("distinct_canonical"), (F.count("canonical") - F.countDistinct("canonical")).alias("copies"),
        (F.sum("literals") / F.sum("clauses")).alias("mean_width"), (F.sum("clauses") / F.sum("variables")).alias("clause_ratio"), F.percentile_approx("variables", 0.5, 10_000).alias("median_variables"), F.percentile_approx("clauses", 0.5, 10_000).alias("median_clauses"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line under an explicit schema: status, line digest and file; blank lines are errors."""
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    status = F.when(F.trim("value") == "", "blank_line").when(~F.is_valid_utf8("value"), "invalid_utf8").when(F.json_object_keys("value").isNull(), "parse_error").otherwise("success")
    return parsed.select("file", F.sha2("value", 256).alias("digest"), status.alias("status"), F.when(status == "success", F.col("record")).alias("record"))


def manifest(lines: DataFrame) -> DataFrame:
    """Rows, good rows and digest of each file, whatever the order of its lines.

    Lines are dealt by their own digest; the sorted digests of each share are
    hashed, then the hashes of the shares.
    """
    share = lines.groupBy("file", F.substring("digest", 1, 3).alias("_share")).agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "success").alias("good"), F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("d"))
    return share.groupBy("file").agg(F.sum("rows").alias("rows"), F.sum("good").alias("good"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_share", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))
