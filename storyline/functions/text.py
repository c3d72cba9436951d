"""Text expressions: cleaning, keys, tokens, ids.  All are built-in functions, none a UDF."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyline.functions import fixed_values as V

# The five XML entities and the space.
XML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
TITLE_EXTRA_STOP_WORDS = ["속보", "단독", "종합", "포토", "영상"]
SIMPLE_STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this", "are", "was", "has"]


def blank_to_null(value: Column) -> Column:
    """Empty strings are missing; blanks are kept."""
    return F.when(value != "", value)


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeezed(value: Column) -> Column:
    """White space runs to one space, stripped at both ends."""
    return F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), "^ | $", "")


def unescaped(value: Column) -> Column:
    for entity, char in XML_ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def clean_text(value: Column, limit: int = 240) -> Column:
    """Unescaped, squeezed, and cut to ``limit`` characters with an ellipsis."""
    cut = lambda text: F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))
    return let(squeezed(unescaped(F.coalesce(value, F.lit("")))), cut)


def strip_html(value: Column, limit: int = 420) -> Column:
    return clean_text(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]*>", " "), limit)


def without_marks(title: Column) -> Column:
    """A title without leading [..], without 【..】 and (..), and without what follows its last dash or bar."""
    title = F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s*\[[^\]]*\]|【[^】]*】|\([^)]*\)", " ")
    return F.regexp_replace(title, r"\s*[-|–—]\s*[^-|–—]+$", "")


def title_key(title: Column) -> Column:
    """Equality key of a title: only [a-z0-9] and Hangul syllables are left."""
    return F.regexp_replace(F.lower(without_marks(title)), "[^a-z0-9가-힣]+", "")


def title_words(title: Column) -> Column:
    """The title for comparison: lower case, words of [a-z0-9] and Hangul parted by one space."""
    return F.trim(F.regexp_replace(F.lower(without_marks(title)), "[^a-z0-9가-힣]+", " "))


def title_tokens(title: Column) -> Column:
    """Distinct words of a title but for stop words."""
    stop = F.array(*map(F.lit, [*V.STOP_WORDS, *TITLE_EXTRA_STOP_WORDS, ""]))
    return F.array_sort(F.array_except(F.split(title_words(title), " "), stop))


def title_numbers(title: Column) -> Column:
    """Distinct numbers of a title, with a letter that follows at once (``12``, ``3b``), ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"\b[0-9]+[a-z]?\b"), F.lit(0))))


def simple_tokens(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9가-힣]+", " ")), " ")
    return F.array_sort(F.array_except(F.filter(words, lambda w: F.char_length(w) > 2), F.array(*map(F.lit, SIMPLE_STOP_WORDS))))


def _same_words() -> dict[str, str]:
    return {word: stem for stem, words in V.SAME_WORDS.items() for word in words}


def stem(word: Column, aliases: dict[str, str] | None = None) -> Column:
    """A word's stem: an equivalence, else the first suffix cut that leaves three letters; then an alias's entity."""
    same = F.create_map(*(F.lit(x) for pair in _same_words().items() for x in pair))
    cut = word
    for suffix in reversed(V.SUFFIXES):
        n = len(suffix)
        cut = F.when(word.endswith(suffix) & (F.char_length(word) >= n + 3), F.substring(word, F.lit(1), F.char_length(word) - n)).otherwise(cut)
    name = lambda w: F.coalesce(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[w], w) if aliases else w
    return F.when(F.char_length(word) <= 3, name(word)).otherwise(F.coalesce(same[word], name(cut)))


def stems(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Distinct stems of the words of a text, without stop words, single characters and numbers."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, V.STOP_WORDS))
    kept = F.filter(F.array_except(words, stop), lambda w: (F.char_length(w) > 1) & ~w.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: stem(w, aliases))))


def hashed_id(prefix: str, value: Column) -> Column:
    """``prefix`` and the first 16 hex digits of the SHA-256 of the stripped value."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.trim(value), 256), 1, 16))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def version_number(value: Column) -> Column:
    """``12.0`` is ``12``; other numbers stay."""
    return F.regexp_replace(value, r"^([0-9]+)\.0$", "$1")


def cut_at_word(text: Column, limit: int = 6000) -> Column:
    """Texts over ``limit`` characters end at a word, with an ellipsis."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", ""), F.lit("…")))


def bordered(word: str, inside: str = "a-z0-9", rest: str = "") -> str:
    """The pattern ``(^|[^inside])word rest([^inside]|$)`` of a plain word, which looks for the word first and at its borders only where it stands."""
    w = re.escape(word)
    return f"{w}(?<![{inside}]{w}){rest}(?![{inside}])"


def matches(low: Column, pattern: str) -> Column:
    """``low.rlike(pattern)``; of ``(^|[^a-z])(one|two)([^a-z]|$)`` and the like each alternative that begins with plain letters is looked for by these."""
    shape = re.fullmatch(r"\(\^\|\[\^([a-z0-9-]+)\]\)(?:\(([^()]*)\)|([^()|]*))\(\[\^\1\]\|\$\)", pattern)
    each = (shape[2] if shape[2] is not None else shape[3]).split("|") if shape else []
    plain = [re.match(r"([a-z0-9 ]+)(?![a-z0-9 *+?{])(.*)", x) for x in each]
    if not each or not all(plain):
        return low.rlike(pattern)
    return reduce(or_, (F.contains(low, F.lit(x[1])) & low.rlike(bordered(x[1], shape[1], x[2])) for x in plain))


def has_word(text: Column, word: str, low: Column | None = None) -> Column:
    """A word between characters that aren't ASCII letters or digits; words with other characters are found anywhere.

    ``low`` is the text in lower case, for callers that look for many words.
    """
    low = F.lower(text) if low is None else low
    found = F.contains(low, F.lit(word.lower()))
    # most texts don't hold the word at all, which a plain search tells sooner than the pattern
    return found if re.search(r"[^a-zA-Z0-9\s\-._/]", word) else found & low.rlike(bordered(word.lower()))


def has_any(text: Column, words: list[str], low: Column | None = None) -> Column:
    """Whether any of the words is in the text (:func:`has_word`)."""
    low = F.lower(text) if low is None else low
    return reduce(or_, (has_word(text, w, low) for w in words), F.lit(False))


def half_even(value: Column, digits: int) -> Column:
    """Rounding half to even."""
    return F.bround(value, digits)
