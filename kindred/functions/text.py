"""Name normalisation as column expressions: folding, prefixes, numerals and small string helpers. No UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTRICT, CONDO = "district", "condo"
PREFIXES: dict[str, tuple[str, ...]] = {
    DISTRICT: ("setor", "jardim", "parque", "vila", "residencial", "conjunto", "nucleo", "bairro"),
    CONDO: ("edificio", "condominio", "residencial", "torre", "bloco", "ed", "cond"),
}
ONE_PREFIX: dict[str, tuple[str, ...]] = {DISTRICT: (*PREFIXES[DISTRICT], "jd", "pq", "res", "conj"), CONDO: PREFIXES[CONDO]}
_ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
NUMERALS = {w: str(k) for k, w in enumerate(_ROMAN, 1)} | {w: str(k) for k, w in enumerate(("um", "dois", "tres", "quatro", "cinco"), 1)}
#: The shorter list that pair search uses.
SHORT_NUMERALS = {k: NUMERALS[k] for k in ("i", "ii", "iii", "iv", "v", "um", "dois")}
_SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters without: equally long, for translate would delete what has no partner."""
    source, target = [], []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != c:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _accents()


def unaccent_lower(c: Column) -> Column:
    """Lower case without diacritics, precomposed or combining."""
    return F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), "[\\u0300-\\u036f]", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def fold(c: Column) -> Column:
    """unaccent_lower with white space collapsed and trimmed."""
    return collapse(unaccent_lower(c))


def strip_prefixes(c: Column, prefixes: Sequence[str]) -> Column:
    """Each prefix of the list in turn, so several may go; the order of the list counts."""
    for p in prefixes:
        c = F.regexp_replace(c, f"^{p}\\s+", "")
    return c


def strip_prefix_once(c: Column, prefixes: Sequence[str]) -> Column:
    """At most one prefix, followed by one space."""
    return F.regexp_replace(c, f"^({'|'.join(prefixes)}) ", "")


def clean_condo(c: Column) -> Column:
    """One prefix off; runs of separators become spaces; spaces collapse."""
    c = F.regexp_replace(strip_prefix_once(unaccent_lower(c), ONE_PREFIX[CONDO]), "[|()/-]+", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def clean_district(c: Column) -> Column:
    return F.trim(strip_prefix_once(unaccent_lower(c), ONE_PREFIX[DISTRICT]))


def numerals(c: Column, words: dict[str, str] = NUMERALS) -> Column:
    """Roman and spelt numerals as digits, whole words only."""
    for word, digit in words.items():
        c = F.regexp_replace(c, f"(?i)\\b{word}\\b", digit)
    return c


def normalise(c: Column, kind: str | None) -> Column:
    """Fold, strip the prefixes of the kind, map numerals, collapse."""
    return collapse(numerals(strip_prefixes(fold(c), PREFIXES.get(kind or "", ()))))


def cache_key(c: Column) -> Column:
    return F.regexp_replace(fold(c), " ", "-")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "\\D", "")


def postal_code(c: Column) -> Column:
    """Eight digits, or null."""
    d = digits(c)
    return F.when(F.length(d) == 8, d)


def join_parts(*parts: Column) -> Column:
    """The parts that are neither null nor empty, with ", " between."""
    return F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))


def first_object(c: Column) -> Column:
    """From the first { to the last } of a text, code fences off; empty if there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, "(?i)```json\\s*", ""), "```\\s*", ""))
    return F.regexp_extract(bare, "(?s)\\{.*\\}", 0)


def clamp01(c: Column) -> Column:
    d = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(d), F.lit(0.0)).otherwise(d)))


def round2(c: Column) -> Column:
    """floor(100 x + 0.5) / 100."""
    return F.floor(c * 100 + 0.5) / 100


def contains_folded(c: Column, needle: str) -> Column:
    """Substring test without case and accents; the needle is taken literally."""
    return unaccent_lower(c).contains(unaccent_lower(F.lit(needle)))
