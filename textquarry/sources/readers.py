"""Inputs: literal texts, line files, whole files, JSON cases, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SchemaError

# Limits and fields of a request.
BODY_BYTES = 1 << 20
REQUEST = "model string, text string, entities array<string>, relations array<string>, json array<string>, classify array<string>, legacy_structures boolean, threshold double, spans boolean, confidence boolean, overlap string, max_words int"
LISTS = ["entities", "relations", "json", "classify"]
OVERLAPS = ["allow", "all", "none", "nested", "allow_nested", "flat", "disallow", "no_overlap", "non_overlapping", "longest", "keep_longest"]


def literal_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(doc_id, text), numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spread(rows: DataFrame) -> DataFrame:
    """A table that reads as fewer tasks than there are cores, as a small one or one of few large row groups does, dealt to all
    of them; any other one as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def non_blank(lines: DataFrame, col: str = "value") -> DataFrame:
    """Without lines that are nothing but white space; the others keep theirs."""
    return lines.where(~F.col(col).rlike(r"(?U)^\s*\z"))


def line_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one text a line. The id is file-local position dependent: unique, rising, not gapless."""
    return non_blank(spark.read.text(path)).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one text a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_cases(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An array of cases, one row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def label_sets(spark: SparkSession, path: str) -> DataFrame:
    return json_cases(spark, path, "labels array<string>, true_label string, exercise string")


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): a page's text without scripts, styles, comments and tags."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return pages.select("page_id", "url", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))


def _first_problem(problems: list[tuple[Column, str, str]]) -> Column:
    out = F.lit(None).cast("struct<message:string,type:string,code:int,param:string>")
    for bad, param, message in reversed(problems):
        error = F.struct(F.lit(message).alias("message"), F.lit("invalid_request_error").alias("type"), F.lit(422).alias("code"), F.lit(param).alias("param"))
        out = F.when(bad, error).otherwise(out)
    return out


def _wrong_types(body: Column) -> Column:
    """Whether some field of a JSON object (a variant) has a type that the request's field can't have."""
    kind = lambda f: F.schema_of_variant(F.try_variant_get(body, f"$.{f}", "variant"))  # noqa: E731  null if absent, VOID if null
    lists = [F.try_variant_get(body, f"$.{f}", "array<string>") for f in LISTS]
    strings = lambda f, v: kind(f).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(v, lambda x: x.isNull())
    number = kind("threshold").isin("BIGINT", "DOUBLE", "FLOAT") | kind("threshold").startswith("DECIMAL")
    whole = (kind("max_words") == "BIGINT") & (F.try_variant_get(body, "$.max_words", "long") >= 0)
    wrong = F.coalesce(kind("text") != "STRING", F.lit(True))
    for bad in [
        *[~kind(f).isin("STRING", "VOID") for f in ("model", "overlap")], *[~F.coalesce(strings(f, v), F.lit(False)) & kind(f).isNotNull() for f, v in zip(LISTS, lists, strict=True)],
        *[kind(f) != "BOOLEAN" for f in ("legacy_structures", "spans", "confidence")], ~number, (kind("max_words") != "VOID") & ~F.coalesce(whole, F.lit(False)),
    ]:
        wrong = wrong | F.coalesce(bad, F.lit(False))
    return wrong


def validated_requests(requests: DataFrame, body_col: str = "body", type_col: str = "content_type", models: list[str] | None = None, supports: list[str] | None = None) -> DataFrame:
    """Adds ``request`` (parsed), ``status`` (200, or 422 if something is wrong) and ``error`` (what is wrong first).

    The order of checks is: size, content type, JSON with known fields of the right types, model, blank text, threshold, overlap,
    schema, and what the scorer ``supports`` (of the fields in ``LISTS``; None: all). An absent content type passes.
    """
    known = [f.split()[0] for f in REQUEST.split(", ")]
    parsed = F.from_json(body_col, REQUEST, {"mode": "PERMISSIVE"})
    body, keys, r = F.try_parse_json(body_col), F.json_object_keys(body_col), F.col("request")
    mime = F.trim(F.element_at(F.split(type_col, ";"), 1))
    empty = lambda c: F.coalesce(F.size(r[c]), F.lit(0)) < 1
    overlap = F.translate(F.lower(F.trim(r["overlap"])), "-", "_")
    unequal = lambda c: F.coalesce(F.exists(r[c], lambda x: ~x.contains("=")), F.lit(False))
    problems = [
        (F.octet_length(body_col) > BODY_BYTES, "body", "request body exceeds the 1 MiB limit"),
        (F.coalesce((mime != "application/json") & ~mime.endswith("+json"), F.lit(False)), "Content-Type", "Content-Type must be application/json"),
        (body.isNull() | keys.isNull(), "body", "invalid request: no JSON object"),
        (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0, "body", "invalid request: unknown field"),
        (_wrong_types(body), "body", "invalid request: a field is missing or of a wrong type"),
        (F.coalesce(~r["model"].isin(models), F.lit(False)) if models else F.lit(False), "model", f"Loaded model is {', '.join(map(repr, models or []))}"),
        (r["text"].rlike(r"(?U)^\s*\z"), "text", "text must not be empty"),
        (~F.coalesce(r["threshold"], F.lit(0.5)).between(0.0, 1.0), "threshold", "threshold must be between 0 and 1"),
        (F.coalesce(~overlap.isin(OVERLAPS), F.lit(False)), "overlap", "unknown overlap_policy"),
        (unequal("json"), "schema", "--json expects name=field1,field2"),
        (unequal("classify"), "schema", "--classify expects task=label1,label2"),
        (empty("entities") & empty("relations") & empty("json") & empty("classify"), "schema", "nothing to do: pass json, entities, relations and/or classify"),
        *[(~empty(c), "schema", f"this model only supports {', '.join(supports)}") for c in LISTS if supports is not None and c not in supports],
    ]
    out = requests.withColumn("request", parsed).withColumn("error", _first_problem(problems))
    return out.withColumn("status", F.coalesce("error.code", F.lit(200)))


def pick_checkpoint(path: str | None, variant: str | None, variants: dict[str, str], default: str) -> str:
    """An explicit path, else the named variant, else the default one."""
    if path:
        return path
    name = variant or default
    if name not in variants:
        raise SchemaError(f"unknown variant {name!r}; known: {', '.join(sorted(variants))}")
    return variants[name]


def stdin_lines(spark: SparkSession, stream) -> DataFrame:
    """(doc_id, text): the non-blank lines of an open text stream. For interactive use; the lines pass through the driver."""
    return literal_texts(spark, [x.rstrip("\r\n") for x in stream if x.strip()])


def stdin_text(spark: SparkSession, stream) -> DataFrame:
    """(doc_id, text): all of an open text stream as one text."""
    return literal_texts(spark, [stream.read()])
