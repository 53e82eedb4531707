"""Library functions for Spark SQL, as temporary SQL functions (inlined by the optimizer)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from civiltext.functions.text import NOT_SPACE, NOT_WORD, SPACE_CHARS, variant_guard, variant_patterns
from civiltext.values import rules


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(value: str, *steps: tuple[str, str]) -> str:
    """Regular expressions replaced one after the other."""
    for pattern, target in steps:
        value = f"regexp_replace({value}, {_text(pattern)}, {_text(target)})"
    return value


def _shapes(value: str, profile: str) -> str:
    for shape, letter in rules.SHAPES[profile]:
        value = f"replace({value}, {_text(shape)}, {_text(letter)})"
    return value


def _variants(variants: list[tuple[str, str]]) -> str:
    """Texts without any variant are left after one scan."""
    return f"CASE WHEN regexp_like(t, {_text(variant_guard(variants))}) THEN {_replaced('t', *variant_patterns(variants))} ELSE t END"


def _profiles() -> dict[str, str]:
    """The category and the config normaliser, from smaller functions that stand before them."""
    runs, few = r"([^\n])\1{2,}", [("!{2,}", "!"), (r"\?{2,}", "?")]
    squeezed = _replaced("lower(t)", (runs, "$1$1"), (r"([aeiou])\1+", "$1"))
    words = "array_join(regexp_extract_all({}, {}, 0), ' ')"
    plain = words.format(_shapes("deleet_category(rewrite_variants_category(" + squeezed + "))", "category"), _text(NOT_SPACE + "+"))
    joined = _replaced(plain, *few, (r"\.{3,}", "..."), ("-{2,}", "-"), (r"\*{2,}", "*"), (r"([a-z])[-_*@#$%^&+=|~`]([a-z])", "$1$2"))
    bare = _replaced("w", (f"^{NOT_WORD}+|{NOT_WORD}+$", ""))
    config = _shapes("deleet_config(rewrite_variants_config(lower(t)))", "config")
    config = _replaced(config, (runs, "$1"), *few, (r"\.{4,}", "..."))
    return {
        "rewrite_variants_category": f"(t STRING) RETURNS STRING RETURN {_variants(rules.CATEGORY_VARIANTS)}",
        "rewrite_variants_config": f"(t STRING) RETURNS STRING RETURN {_variants(rules.CONFIG_VARIANTS)}",
        "trim_word_edges": f"(t STRING) RETURNS STRING RETURN array_join(filter(transform(regexp_extract_all(t, {_text(NOT_SPACE + '+')}, 0), w -> {bare}), w -> w != ''), ' ')",
        "normalise_category": f"(t STRING) RETURNS STRING RETURN trim_word_edges({joined})",
        "normalise_config": f"(t STRING) RETURNS STRING RETURN btrim({config}, {_text(SPACE_CHARS)})",
    }


def definitions() -> dict[str, str]:
    """Function signature and body per name; later ones may call earlier ones. ``word_places`` returns a table."""
    levels = " ".join(f"WHEN {_text(s)} THEN {i}" for i, s in enumerate(rules.SEVERITIES))
    bands = " ".join(f"WHEN c >= {low}D THEN {_text(n)}" for n, low in reversed(rules.SEVERITY_BANDS))
    punct = "regexp_replace(regexp_replace(regexp_replace({}, '!{{2,}}', '!'), '[?]{{2,}}', '?'), '[.]{{3,}}', '...')"
    out = {
        "sev_rank": f"(s STRING) RETURNS INT RETURN CASE s {levels} ELSE 0 END",
        "severity_band": f"(c DOUBLE) RETURNS STRING RETURN CASE {bands} ELSE 'none' END",
        "confidence_bucket": "(c DOUBLE) RETURNS INT RETURN CAST(floor(c * 10) * 10 AS INT)",
        "word_tokens": r"(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(t), r'[\p{L}\p{N}_]+', 0)",
        "normalise_multilingual": f"(t STRING) RETURNS STRING RETURN {punct.format(f'btrim(lower(t), {_text(SPACE_CHARS)})')}",
    }
    for profile, (source, target) in rules.LEET.items():
        out[f"deleet_{profile}"] = f"(t STRING) RETURNS STRING RETURN translate(t, {_text(source)}, {_text(target)})"
    source, target = rules.LEET["legacy"]
    leet = f"translate(lower(t), {_text(source)}, {_text(target)})"
    out["normalise_legacy"] = f"(t STRING) RETURNS STRING RETURN {punct.format(leet)}"
    out |= _profiles()
    out["word_places"] = r"(t STRING) RETURNS TABLE (place INT, word STRING) RETURN SELECT p.pos, p.col FROM posexplode(regexp_extract_all(lower(t), r'[\p{L}\p{N}_]+', 0)) AS p"
    return out


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session and return their names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
