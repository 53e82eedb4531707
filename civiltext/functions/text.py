"""Column builders for text: normalising, tokenising and checking messages.

Every builder takes and returns a ``Column`` made of built-in functions, so a
whole normaliser stays inside the JVM and can be used in batch and streaming.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiltext.functions.staging import let
from civiltext.values import rules

WORD_CHARS = r"[\p{L}\p{N}_]"
WORD = WORD_CHARS + "+"
NOT_WORD = r"[^\p{L}\p{N}_]"
# whitespace as Unicode knows it, not only the ASCII part
SPACES = r"\s\x0B\x1C-\x1F\x85\p{Z}"
SPACE, NOT_SPACE = f"[{SPACES}]", f"[^{SPACES}]"
SPACE_CHARS = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has(text: Column, regex: str) -> Column:
    return F.regexp_like(text, F.lit(regex))


def count(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex))


def count_chars(text: Column, char_class: str) -> Column:
    """Characters of a class such as ``\\p{L}``, counted without an array of matches."""
    return F.length(F.regexp_replace(text, char_class.replace(r"\p", r"\P") + "+", ""))


def extract(text: Column, regex: str) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def is_blank(text: Column | str) -> Column:
    text = col(text)
    return text.isNull() | ~has(text, NOT_SPACE)


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(SPACE_CHARS))


def whitespace_words(text: Column | str) -> Column:
    return extract(col(text), NOT_SPACE + "+")


def word_tokens(text: Column | str, lower: bool = True) -> Column:
    """Unicode word tokens in order."""
    text = col(text)
    return extract(F.lower(text) if lower else text, WORD)


def strip_punct_tokens(text: Column | str) -> Column:
    """Delete ASCII punctuation, then split on whitespace."""
    return whitespace_words(F.translate(col(text), PUNCTUATION, ""))


def bounded_tokens(tokens: Column | str, min_len: int = 2, max_len: int = 50) -> Column:
    """Keep tokens whose length lies in the bounds."""
    return F.filter(col(tokens), lambda t: F.length(t).between(min_len, max_len))


def sentences(text: Column | str) -> Column:
    """Split on runs of sentence ends, trailing empty part included (T4)."""
    return F.split(strip(text), r"[.!?]+", -1)


def squeeze_repeats(text: Column | str, keep: int = 2, vowels: bool = True) -> Column:
    """Shorten runs of three or more equal characters to ``keep``; optionally collapse vowels."""
    out = F.regexp_replace(col(text), r"([^\n])\1{2,}", "$1" * keep)
    return F.regexp_replace(out, r"([aeiou])\1+", "$1") if vowels else out


def variant_patterns(variants: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """One alternation per run of neighbouring variants that share a target."""
    runs = groupby(variants, key=lambda pair: pair[1])
    return [(r"\b(?:%s)\b" % "|".join(re.escape(v) for v, _ in run), target) for target, run in runs]


def variant_guard(variants: list[tuple[str, str]]) -> str:
    """One expression that finds any variant, its alternatives grouped by first character."""
    heads = groupby(sorted({v for v, _ in variants}), key=lambda v: v[0])
    return r"\b(?:%s)\b" % "|".join(
        f"{re.escape(head)}(?:{'|'.join(re.escape(v[1:]) for v in group)})" for head, group in heads
    )


def rewrite_variants(text: Column | str, variants: list[tuple[str, str]]) -> Column:
    """Ordered dictionary rewrite at word boundaries (N2); texts without any variant are left after one scan."""
    def chain(t: Column) -> Column:
        out = t
        for pattern, target in variant_patterns(variants):
            out = F.regexp_replace(out, pattern, target)
        return F.when(has(t, variant_guard(variants)), out).otherwise(t)

    return let(col(text), chain)


def deleet(text: Column | str, profile: str) -> Column:
    """Replace look-alike characters by letters."""
    source, target = rules.LEET[profile]
    return F.translate(col(text), source, target)


def deleet_shapes(text: Column | str, profile: str) -> Column:
    """Replace multi-character letter shapes."""
    out = col(text)
    for shape, letter in rules.SHAPES[profile]:
        out = F.replace(out, F.lit(shape), F.lit(letter))
    return out


def collapse_punct(text: Column | str, profile: str = "multilingual") -> Column:
    """Shorten runs of punctuation."""
    out = F.regexp_replace(col(text), r"([!?*-])\1+" if profile == "category" else r"([!?])\1+", "$1")
    return F.regexp_replace(out, r"\.{4,}", "...")


def join_separators(text: Column | str) -> Column:
    """Delete a single separator standing between two letters."""
    return F.regexp_replace(col(text), r"([a-z])[-_*@#$%^&+=|~`]([a-z])", "$1$2")


def trim_edges(text: Column | str) -> Column:
    """Strip non-word characters at both ends of every word, drop empty words."""
    # from the first to the last word character of every run without whitespace
    return F.array_join(extract(col(text), f"{WORD_CHARS}(?:{NOT_SPACE}*{WORD_CHARS})?"), " ")


def normalise(text: Column | str, profile: str) -> Column:
    """The full normaliser of one scoring profile."""
    out = F.lower(col(text))
    if profile == "legacy":
        return collapse_punct(deleet(out, profile))
    if profile == "multilingual":
        return collapse_punct(strip(out))
    if profile == "category":
        out = rewrite_variants(squeeze_repeats(out), rules.CATEGORY_VARIANTS)
        out = deleet_shapes(deleet(out, profile), profile)
        return trim_edges(join_separators(collapse_punct(out, profile)))
    if profile == "config":
        out = deleet_shapes(deleet(rewrite_variants(out, rules.CONFIG_VARIANTS), profile), profile)
        return strip(collapse_punct(squeeze_repeats(out, keep=1, vowels=False), profile))
    raise ValueError(f"unknown profile {profile!r}")


def category_tokens(text: Column | str, lower: bool = True) -> Column:
    """Tokens of the category normaliser, without the steps that cannot change tokens."""
    text = col(text)
    out = rewrite_variants(squeeze_repeats(F.lower(text) if lower else text), rules.CATEGORY_VARIANTS)
    out = deleet_shapes(deleet(out, "category"), "category")
    out = F.regexp_replace(out, r"([-*])\1+", "$1")
    return extract(join_separators(out), WORD)


def mixed_case_words(text: Column | str) -> Column:
    """Number of words over three characters whose case flips more than length/3 times."""
    flips = lambda w: F.regexp_count(w, F.lit(r"\p{Lu}(?=\P{Lu})|\P{Lu}(?=\p{Lu})"))
    words = whitespace_words(text)
    return F.size(F.filter(words, lambda w: (F.length(w) > 3) & (flips(w) > F.floor(F.length(w) / 3))))


def is_polite(lower_text: Column, tokens: Column) -> Column:
    """A courtesy phrase is contained or a polite word is a token (V4)."""
    phrase = F.lit(False)
    for p in rules.POLITE_PHRASES:
        phrase = phrase | F.contains(lower_text, F.lit(p))
    return phrase | F.arrays_overlap(tokens, F.array(*map(F.lit, rules.POLITE_WORDS)))


def preview(text: Column | str, length: int = 50) -> Column:
    """Cut to ``length`` characters, the last three being dots (V6)."""
    text = col(text)
    return F.when(F.length(text) <= length, text).otherwise(
        F.concat(F.substring(text, 1, length - 3), F.lit("..."))
    )


def sanitise_html(html: Column | str) -> Column:
    """Drop script blocks, then all tags, then outer whitespace (V3)."""
    out = F.regexp_replace(col(html), r"(?is)<script\b.*?</script>", "")
    return strip(F.regexp_replace(out, r"<[^>]*>", ""))


def text_issues(text: Column | str, max_length: int = rules.MAX_TEXT_LENGTH) -> Column:
    """Validation issues of a message as an array (V1)."""
    text = col(text)
    return F.array_compact(
        F.array(
            F.when(text.isNull(), "not_text"),
            F.when(text.isNotNull() & is_blank(text), "blank"),
            F.when(F.length(strip(text)) > max_length, "too_long"),
        )
    )
