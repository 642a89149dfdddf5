"""SQL surface: the text helpers as Spark SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN``,
evaluated natively, no Python) and Jaro-Winkler as a registered Arrow UDF, so users can write the
reference's queries as SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tagloom.functions.jaro import jaro_winkler_udf
from tagloom.functions.text import KAOMOJI
from tagloom.operators.markup import PLAIN_TEXT_RULES


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _plain_text_body() -> str:
    body = "s"
    for pat, rep in PLAIN_TEXT_RULES:
        body = f"regexp_replace({body}, {_q(pat)}, {_q(rep)})"
    return body


def register_functions(spark: SparkSession) -> list[str]:
    kao = ", ".join(_q(k) for k in KAOMOJI)
    defs = {
        "normalise_text": ("s STRING", "STRING", "regexp_replace(lower(s), '[^a-z0-9]+', ' ')"),
        "replace_underscores": ("s STRING", "STRING", f"CASE WHEN s IN ({kao}) THEN s ELSE translate(s, '_', ' ') END"),
        "strip_rating_prefix": ("s STRING", "STRING", "regexp_replace(s, '^rating_', '')"),
        "escape_brackets": ("s STRING", "STRING", r"regexp_replace(s, '([()])', '\\\\$1')"),
        "split_tags": ("s STRING", "ARRAY<STRING>", "filter(transform(split(s, ','), t -> trim(t)), t -> length(t) > 0)"),
        "query_terms": ("s STRING", "ARRAY<STRING>", "regexp_extract_all(lower(s), '([a-z0-9]+)', 1)"),
        "clamp_post_count": ("n INT", "INT", "greatest(n, 1)"),
        "plain_text": ("s STRING", "STRING", _plain_text_body()),
    }
    for name, (args, ret, body) in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    spark.udf.register("jaro_winkler_similarity", jaro_winkler_udf)
    return sorted(defs) + ["jaro_winkler_similarity"]
