"""Stored replies of a judge model to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REPLY = "judgment string, confidence string, reasoning string"


def parse_reply(reply: Column, default_confidence: float = 0.5) -> Column:
    """Struct (judgment, confidence, reasoning, parsed): JSON between the first and the last brace, code fences aside.

    Where that isn't JSON, the reply is hallucinated if it says so anywhere, grounded otherwise, at confidence 0.5.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?m)^```(?:json)?|```$", ""))
    data = F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), REPLY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = F.get_json_object(F.regexp_extract(bare, r"(?s)\{.*\}", 0), "$").isNotNull()
    said = F.when(F.lower(bare).contains("hallucinated"), "hallucinated").otherwise("grounded")
    confidence = F.coalesce(data["confidence"].try_cast("double"), F.lit(default_confidence))
    return F.struct(
        F.when(parsed, F.coalesce(data["judgment"], F.lit("grounded"))).otherwise(said).alias("judgment"),
        F.when(parsed, confidence).otherwise(F.lit(0.5)).alias("confidence"),
        F.when(parsed, F.coalesce(data["reasoning"], F.lit(""))).otherwise(F.lit("")).alias("reasoning"),
        parsed.alias("parsed"),
    )
