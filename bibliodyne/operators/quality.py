"""Evaluation jobs over extraction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bibliodyne.operators.vectors import cosine


def text_field_grades(fields: DataFrame, good: float = 0.8, fair: float = 0.6) -> DataFrame:
    """Adds ``grade`` to rows with actual, expected and their embeddings: both empty PASS, one empty FAIL, else
    by cosine."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    a, e = blank(F.col("actual")), blank(F.col("expected"))
    s = cosine(F.col("actual_embedding"), F.col("expected_embedding"))
    grade = F.when(a & e, "PASS").when(a | e, "FAIL").when(s >= good, "PASS").when(s >= fair, "WARN").otherwise("FAIL")
    return fields.withColumn("similarity", s).withColumn("grade", grade)


def null_honesty(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(doi, field, value): fields that should be empty and are filled."""
    filled = actual.filter(F.coalesce(F.trim("value"), F.lit("")) != "")
    return expected.filter("expected_null").select("doi", "field").join(filled.select("doi", "field", "value"), ["doi", "field"])


def model_comparison(outputs: DataFrame) -> DataFrame:
    """Per model: missing required fields, papers of which nothing was extracted, fabrications and mean seconds a
    paper (rows model, doi, required, value, expected_null, seconds)."""
    empty = F.coalesce(F.trim("value"), F.lit("")) == ""
    papers = outputs.groupBy("model", "doi").agg(
        F.count_if(F.col("required") & empty).alias("missing"), F.bool_and(empty).alias("blank"), F.count_if(F.col("expected_null") & ~empty).alias("made"), F.max("seconds").alias("seconds"),
    )
    return papers.groupBy("model").agg(F.sum("missing").alias("missing_required"), F.count_if("blank").alias("empty_outputs"), F.sum("made").alias("fabrications"), F.avg("seconds").alias("mean_seconds"))


def schema_drift(written: StructType, live: StructType) -> dict[str, list[str]]:
    """Columns on one side only, and those of another type."""
    w, v = {f.name: f.dataType for f in written}, {f.name: f.dataType for f in live}
    return {"unknown": sorted(w.keys() - v.keys()), "missing": sorted(v.keys() - w.keys()), "retyped": sorted(c for c in w.keys() & v.keys() if w[c] != v[c])}


def require_schema(df: DataFrame, live: StructType) -> DataFrame:
    """``df`` if it fits the live schema, else an error that names the differences."""
    drift = {k: c for k, c in schema_drift(df.schema, live).items() if c}
    if drift:
        raise ValueError(f"schema drift: {drift}")
    return df


def failed_phases(papers: DataFrame, column: str = "extraction") -> DataFrame:
    """(doi, phases) of papers whose ``_phase_errors`` has a non-empty entry."""
    errors = F.from_json(F.get_json_object(column, "$._phase_errors"), "map<string,string>")
    bad = F.map_filter(errors, lambda _, v: F.coalesce(F.trim(v), F.lit("")) != "")
    return papers.withColumn("phases", F.array_sort(F.map_keys(bad))).filter(F.size("phases") > 0).select("doi", "phases")


def normalise_extraction(fields: DataFrame, schema: DataFrame) -> DataFrame:
    """Long-form fields (doi, field, value, confidence) cleaned by a schema (field, valid_values or null):
    empty and out-of-vocabulary values become null, null values absent, unknown confidences explicit.
    ``violation`` marks values that the vocabulary rejects."""
    rules = schema.select("field", "valid_values")
    value = F.nullif(F.trim("value"), F.lit(""))
    violation = F.coalesce(value.isNotNull() & F.col("valid_values").isNotNull() & ~F.array_contains(F.coalesce("valid_values", F.array(F.lit(""))), F.coalesce(value, F.lit(""))), F.lit(False))
    out = fields.join(rules, "field", "left").withColumn("violation", violation).withColumn("value", F.when(~violation, value))
    known: Column = F.col("confidence").isin("explicit", "inferred", "absent")
    confidence = F.when(F.col("value").isNull(), "absent").when(known, F.col("confidence")).otherwise("explicit")
    return out.withColumn("confidence", confidence).drop("valid_values")
