"""Text expressions: gibberish, refusals, fenced blocks, noise, JSON inside text, list items, plain words.

All are column expressions on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fenced block, refusal phrases, list marker.
FENCE_PATTERN = r"(?is)```(?:sql|json|python|text)?\s*(.*?)```"
REFUSAL_PATTERNS = (
    r"\bi\s+(?:cannot|cant|can't|won't|am\s+unable|don't\s+know|am\s+sorry|apologize)",
    r"\bas\s+an\s+ai",
    r"i'm\s+(?:sorry|not\s+able)",
    r"i\s+don't\s+have\s+(?:access|enough)",
    r"cannot\s+(?:provide|help|assist)",
)
LIST_MARK_PATTERN = r"^(?:[0-9]+[.)]\s*[.):]?|[-*]\s*|\x{2022}\s*)\s*(.*)$"

# Words without content, and keyboard noise (runs of one letter are told by rule).
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "is", "are", "was", "were", "be", "been",
    "being", "to", "of", "in", "on", "for", "with", "at", "by", "from", "it", "this", "that", "these",
    "those", "as", "how", "why", "when", "where", "who", "what", "which", "show", "tell", "give", "me",
    "please", "hi", "hello", "do", "does", "can", "could", "would", "should", "the", "your", "our",
    "there", "their", "you", "you're", "yours", "yourself", "am", "we", "we're", "us", "them", "they",
    "they're", "i", "i'm", "im", "he", "she", "it's", "its", "his", "her",
)
NOISE_WORDS = (
    "asdf", "asdfg", "asdfgh", "asdfghj", "fdsa", "sadf", "dsf", "fds", "qwerty", "qwer", "wert", "poiu",
    "poiuy", "rewq", "ytrewq", "sdfg", "dfgh", "fghj", "ghjk", "hjkl", "jkl", "klj", "kjhg", "zxcv",
    "zxcvb", "xcvbn", "cvbnm", "mnbvc", "vbnm", "nbvc", "bvcx", "asdfjkl", "qwe", "rty", "uio", "p",
    "sdf", "fgh", "lkj", "test", "testing", "test123", "abc", "abcd", "abcde", "xyz", "xy", "lorem",
    "ipsum", "loremipsum", "fuck", "shit", "poop", "butt",
)

# Jargon and its plain form.
PLAIN_WORDS = (
    ("standard deviation", "typical variation"),
    ("standard deviations", "typical variations"),
    ("median", "middle value"),
    ("coefficient of variation", "relative variation"),
    ("dispersion", "spread"),
    ("z-score", "deviation score"),
    ("stats", "statistics"),
)


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fence_body(text: Column) -> Column:
    """Longest fenced block of the text, or the trimmed text without one."""
    def longest(whole: Column) -> Column:
        blocks = F.transform(F.regexp_extract_all(whole, F.lit(FENCE_PATTERN), F.lit(1)), stripped)
        sized = F.transform(blocks, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b")))
        return F.when(whole.contains("```"), F.coalesce(F.array_max(sized)["b"], whole)).otherwise(whole)

    return let(stripped(F.coalesce(text, F.lit(""))), longest)


def is_refusal(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for pattern in REFUSAL_PATTERNS:
        out = out | low.rlike(pattern)
    return out


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def is_gibberish(text: Column, min_letters: int = 6) -> Column:
    """Too few letters, too few different ones, or one character repeated, after unfencing."""
    return let(fence_body(text), lambda body: _gibberish_body(body, min_letters))


def _gibberish_body(body: Column, min_letters: int = 6) -> Column:
    def few(only: Column) -> Column:
        kinds = F.size(F.array_distinct(F.filter(F.split(only, ""), lambda c: c != "")))
        return (F.length(only) < min_letters) | F.coalesce(F.try_divide(kinds, F.length(only)) < 0.35, F.lit(False))

    return (body == "") | body.rlike(r"^([A-Za-z0-9])\1{4,}$") | let(letters(body), few)


def text_verdict(text: Column) -> Column:
    """Why a text is not to be trusted: empty output, refusal detected, gibberish output; null if it is fine."""
    def verdict(body: Column) -> Column:
        return (
            F.when(body == "", "empty output").when(is_refusal(body), "refusal detected")
            .when(_gibberish_body(body), "gibberish output")
        )

    return let(fence_body(text), verdict)


def noise_verdict(text: Column) -> Column:
    """Why a text is no real question: empty, no letters, too short, single letters, noise word, stop words only."""
    low = F.lower(stripped(F.coalesce(text, F.lit(""))))
    tokens = F.regexp_extract_all(low, F.lit(r"([a-z]+(?:'[a-z]+)?)"), F.lit(1))
    return let(F.struct(low.alias("low"), tokens.alias("tokens")), lambda x: _noise(x["low"], x["tokens"]))


def _noise(low: Column, tokens: Column) -> Column:
    real = F.filter(tokens, lambda t: F.length(t) >= 2)

    def noisy(t: Column) -> Column:
        long = F.length(t) >= 4
        few = F.size(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))) <= 2
        return t.rlike(r"^(.)\1{3,}$") | (long & few) | (long & ~t.rlike("[aeiouy]")) | t.isin(*NOISE_WORDS)

    return (
        F.when(low == "", "empty").when(~low.rlike("[a-z]"), "no letters").when(F.size(tokens) < 2, "too short")
        .when(F.size(real) < 2, "single letters").when(F.exists(F.array_distinct(tokens), noisy), "noise word")
        .when(~F.exists(F.array_distinct(real), lambda t: ~t.isin(*STOP_WORDS)), "stop words only")
    )


def json_in_text(text: Column) -> Column:
    """Struct (kind, json): the whole unfenced text if it is JSON, else the outermost braces, else none."""
    body = fence_body(text)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    whole, part = F.try_parse_json(body), F.try_parse_json(F.nullif(braces, F.lit("")))
    kind = F.when(whole.isNotNull(), "whole").when(part.isNotNull(), "embedded").otherwise("none")
    return F.struct(kind.alias("kind"), F.when(whole.isNotNull(), body).when(part.isNotNull(), braces).alias("json"))


def list_items(text: Column, most: int | None = None) -> Column:
    """Items of a numbered or bulleted list; of prose the sentences, or the whole of it. All of them, or the first `most`."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda s: stripped(F.replace(s, F.lit("*"), F.lit(""))))
    items = F.filter(F.transform(lines, lambda s: stripped(F.regexp_extract(s, LIST_MARK_PATTERN, 1))), lambda s: s != "")
    flat = stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))

    def first(found: Column) -> Column:
        return found if most is None else F.slice(found, 1, most)

    def sentences(whole: Column) -> Column:
        cut = F.split(whole, r"(?<=[.!?])\s+")
        parts = F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"\.+$", "")), lambda s: s != "")
        return let(parts, lambda p: F.when(whole == "", F.slice(p, 1, 0)).when(F.size(p) >= 2, first(p)).otherwise(F.array(whole)))

    return let(items, lambda found: F.when(F.size(found) > 0, first(found)).otherwise(let(flat, sentences)))


def plain_english(text: Column) -> Column:
    for jargon, plain in PLAIN_WORDS:
        text = F.regexp_replace(text, rf"(?i)\b{jargon}\b", plain)
    return text


def plain_tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, without the word `as`."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\bas\b", " ")
    return F.array_distinct(F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != ""))
