"""Text functions. Each takes and returns a Column and stays inside codegen."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 whitespace characters, the URL form, the moderation notice
# and the sequence budget.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Java classes for those 29 characters and for all others. The Latin-1 part is a bit set
# and the rest sits behind one range test, which is about three times as fast as a plain
# list of ranges.
_WS_LATIN = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
_WS_WIDE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NWS_WIDE = (
    r"\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}"
    r"\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}"
)
WS = f"[{_WS_LATIN}[\\x{{1680}}-\\x{{3000}}&&[{_WS_WIDE}]]]"
NWS = f"[[\\x{{0}}-\\x{{167f}}&&[^{_WS_LATIN}]][{_NWS_WIDE}]]"
URL = f"https?://{NWS}+"
MODERATION_NOTICE = "该微博因被投诉违反"
MAX_SEQUENCE_LENGTH = 256


def strip(text: Column) -> Column:
    """Trim every kind of Unicode whitespace from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize(text: Column) -> Column:
    """Null to empty, drop NUL and URLs, collapse whitespace to single spaces, trim."""
    filled = F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(""))
    # Most posts carry no link; the substring test spares them the URL regex.
    unlinked = F.when(filled.contains("http"), F.regexp_replace(filled, URL, "")).otherwise(filled)
    return F.btrim(F.regexp_replace(unlinked, f"{WS}+", " "))


def drop_moderation_notice(text: Column) -> Column:
    """Cut the text at the first moderation notice and trim what is left."""
    return strip(F.substring_index(text, MODERATION_NOTICE, 1))


def clean(text: Column, lang: Column | str, force_notice: bool = False) -> Column:
    """Normalize, and cut moderation notices from Chinese rows (or all, if forced)."""
    tidy = normalize(text)
    if isinstance(lang, str):
        return drop_moderation_notice(tidy) if force_notice or lang == "zh" else tidy
    cut = F.lit(True) if force_notice else lang == "zh"
    return F.when(cut, drop_moderation_notice(tidy)).otherwise(tidy)


def dedupe_key(text: Column) -> Column:
    """Trimmed, lower-cased text: two rows with equal keys are copies."""
    return F.lower(strip(text))


def fingerprint(text: Column) -> Column:
    """Fixed-width stand-in for ``dedupe_key``, so shuffles move 64 bytes, not texts."""
    return F.sha2(dedupe_key(text), 256)


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NWS}+"))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return ~F.coalesce(F.rlike(text, F.lit(NWS)), F.lit(False))


def chunks(text: Column, size: int = MAX_SEQUENCE_LENGTH) -> Column:
    """Array of consecutive ``size``-character pieces; empty text gives an empty array.

    One left-to-right regex pass, so the cost is linear in the text length.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def merge_title_body(title: Column, body: Column) -> Column:
    """``title. body`` without outer dots and spaces; the bare title if there is no body."""
    head, tail = normalize(title), normalize(body)
    joined = F.btrim(F.concat(head, F.lit(". "), tail), F.lit(". "))
    return F.when(F.length(tail) > 0, joined).otherwise(head)


@dataclass(frozen=True)
class Tokenizer:
    """Pluggable tokenizer: two Column functions plus the special tokens it would add.

    ``split`` and ``join`` may be built-in expressions (the default) or Arrow-batched
    functions (:class:`sentiweave.operators.subwords.Subwords`). ``count``, if given, counts
    the tokens without making an array of them; ``first`` joins the first ones without making
    the others.
    """

    split: Callable[[Column], Column]
    join: Callable[[Column], Column]
    special_tokens: int = 0
    count: Callable[[Column], Column] | None = None
    first: Callable[[Column, int], Column] | None = None


def words(text: Column) -> Column:
    """Array of whitespace-separated words; blank text gives an empty array."""
    parts = F.split(strip(text), f"{WS}+")
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(parts)


WORDS = Tokenizer(split=words, join=lambda tokens: F.array_join(tokens, " "), count=word_count)


def truncate_tokens(
    text: Column, limit: int = MAX_SEQUENCE_LENGTH, tokenizer: Tokenizer = WORDS
) -> Column:
    """Keep the first ``limit`` tokens and join them again."""
    filled = F.coalesce(text, F.lit(""))
    if tokenizer.first:
        return tokenizer.first(filled, limit)
    return tokenizer.join(F.slice(tokenizer.split(filled), 1, limit))


def token_count(text: Column, tokenizer: Tokenizer = WORDS) -> Column:
    """Token count with special tokens."""
    filled = F.coalesce(text, F.lit(""))
    size = tokenizer.count(filled) if tokenizer.count else F.size(tokenizer.split(filled))
    return size + F.lit(tokenizer.special_tokens)
