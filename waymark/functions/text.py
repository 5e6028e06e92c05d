"""Search text as Column expressions: normal form, trigrams and the tiers of a match."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ascii_table() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of each letter in ASCII: one character for one, or several."""
    source, target, several = [], [], {}
    for code in (c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode("ascii").lower()
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
        elif plain:
            several[chr(code)] = plain
    return "".join(source), "".join(target), several


_FROM, _TO, _SEVERAL = _ascii_table()


def normal_form(text: Column) -> Column:
    """Lower-case ASCII words with one space between them.

    ASCII texts need no table. In others accents go by a table of single characters, in generated code; only texts with
    ligatures, fractions and the like are taken apart. What is no ASCII after that is dropped, what is no letter or digit
    separates. A null text counts as empty.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    spelt = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    apart = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(spelt, c), c)), "")
    t = F.when((F.octet_length(t) > F.length(t)) & t.rlike("[" + "".join(_SEVERAL) + "]"), apart).otherwise(t)
    table = F.regexp_replace(F.lower(F.translate(t, _FROM, _TO)), r"[^\x00-\x7F]", "")
    plain = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(table)
    return F.trim(F.regexp_replace(plain, "[^0-9a-z]+", " "))


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def trigrams(normal: Column) -> Column:
    """Distinct trigrams inside the words of three letters or more."""
    per_word = F.transform(F.filter(words(normal), lambda w: F.length(w) >= 3), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(per_word))


def _every_token_starts(tokens: Column, in_words: Column) -> Column:
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.exists(in_words, lambda w: F.startswith(w, t)))


def match_tier(query: Column, display: Column, haystack: Column) -> Column:
    """0 equal, 1 prefix, 2 each token starts a visible word, 3 inside the visible text, 4 and 5 the same over all text; else null.

    All three are in normal form; ``display`` is the visible text and ``haystack`` all that may be searched.
    """
    tokens = words(query)
    return (
        F.when(query == "", None)
        .when(query == display, 0)
        .when(F.startswith(display, query), 1)
        .when(_every_token_starts(tokens, words(display)), 2)
        .when(F.contains(display, query), 3)
        .when(_every_token_starts(tokens, words(haystack)), 4)
        .when(F.contains(haystack, query), 5)
    )


def stable_hash(key: Column) -> Column:
    """A 31-bit hash over the bytes of a key: xor with each byte, times 16777619."""
    digits = F.hex(key.cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), (F.length(digits) / 2).cast("int")), lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    start = F.lit(2166136261).cast("long")
    return F.when(digits != "", F.aggregate(codes, start, lambda v, c: (v.bitwiseXOR(c) * 16777619).bitwiseAND(0x7FFFFFFF))).otherwise(start)
