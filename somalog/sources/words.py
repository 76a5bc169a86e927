"""Recognized words of a page: nested pages, blocks, paragraphs and words to word boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOX = "struct<vertices: array<struct<x: double, y: double>>>"
RESPONSE = (
    f"fullTextAnnotation struct<pages: array<struct<blocks: array<struct<paragraphs: array<struct<words: array<struct<boundingBox: {_BOX}, symbols: array<struct<text: string>>>>>>>>>>>, "
    f"textAnnotations array<struct<description: string, boundingPoly: {_BOX}>>"
)


def _boxed(text: Column, vertices: Column) -> Column:
    side = lambda axis, pick: pick(F.transform(vertices, lambda v: F.coalesce(v[axis], F.lit(0.0))))
    return F.struct(text.alias("text"), side("x", F.array_min).alias("left"), side("x", F.array_max).alias("right"), side("y", F.array_min).alias("top"), side("y", F.array_max).alias("bottom"))


def word_boxes(responses: DataFrame) -> DataFrame:
    """(page, response JSON) to (page, text, left, right, top, bottom), one row a word. Responses
    without pages give their flat annotations, but for the first, which is the whole text."""
    parsed = responses.select("page", F.from_json("response", RESPONSE).alias("r"))
    blocks = F.flatten(F.transform(F.coalesce(F.col("r.fullTextAnnotation.pages"), F.array()), lambda p: F.coalesce(p["blocks"], F.array())))
    words = F.flatten(F.transform(F.flatten(F.transform(blocks, lambda b: F.coalesce(b["paragraphs"], F.array()))), lambda p: F.coalesce(p["words"], F.array())))
    nested = F.transform(words, lambda w: _boxed(F.array_join(F.transform(w["symbols"], lambda s: s["text"]), ""), w["boundingBox"]["vertices"]))
    given = F.coalesce(F.col("r.textAnnotations"), F.array())
    flat = F.transform(F.slice(given, F.lit(2), F.size(given)), lambda a: _boxed(a["description"], a["boundingPoly"]["vertices"]))
    return parsed.select("page", F.inline(F.when(F.size(nested) > 0, nested).otherwise(flat))).where(F.col("text") != "")
