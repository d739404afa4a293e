"""Weighted URL vocabulary: one Aho-Corasick pass finds the terms; a term counts only between boundaries.

Every term has a weight: STRICT for strict terms, 1 for soft ones. A URL is rejected if the weights of its distinct terms come to
STRICT or more, that is on one strict term or on several distinct soft terms. A hit is bounded when the characters
before and after it are no ASCII letters or digits. Percent-encoding is undone first; matching folds ASCII case.

The vocabulary is a table, url_terms.csv beside this module unless another is given (README says where it comes from).

Cases: a null or empty URL has no hits and is kept; a term found twice is one distinct term; terms may overlap or be
part of one another, and each is judged on its own boundaries; bytes that are no UTF-8 after decoding become the replacement
character; repeated rows give equal rows; very long URLs are read whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Mapping
from pathlib import Path
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import lean

TERMS = Path(__file__).with_name("url_terms.csv")
STRICT = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
_JOINS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = "page_id long, strict_terms array<string>, soft_terms array<string>, score int, rejected boolean"


def vocabulary(path: str | Path = TERMS) -> dict[str, int]:
    """term -> weight, from a table of two columns."""
    with open(path, newline="") as f:
        return {r["term"]: int(r["weight"]) for r in csv.DictReader(f)}


def automaton(terms: Mapping[str, int]):
    a = ahocorasick.Automaton()
    for t, weight in terms.items():
        if not t or t != t.translate(_FOLD) or weight < 1:
            raise ValueError(f"a term must be lower case and not empty, and weigh something: {t!r}")
        a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def hits(a, url: str) -> dict[str, int]:
    """Distinct bounded terms and their weights, in order of the alphabet."""
    u, found = unquote(url).translate(_FOLD), {}
    if len(a):
        for last, (term, weight) in a.iter(u):
            first = last - len(term) + 1
            if (first == 0 or u[first - 1] not in _JOINS) and (last + 1 == len(u) or u[last + 1] not in _JOINS):
                found[term] = weight
    return dict(sorted(found.items()))


def _run(terms: dict[str, int], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, words = automaton(terms), pa.list_(pa.string())
        for batch in batches:
            found = [hits(a, u or "") for u in batch.column(1).to_pylist()]
            score = [sum(h.values()) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[t for t, w in h.items() if w >= limit] for h in found], words), pa.array([[t for t, w in h.items() if w < limit] for h in found], words), pa.array(score, pa.int32()), pa.array([s >= limit for s in score], pa.bool_())], names=["page_id", "strict_terms", "soft_terms", "score", "rejected"])

    return lean(run)


def url_hits(pages: DataFrame, terms: Mapping[str, int] | None = None, limit: int = STRICT) -> DataFrame:
    """(page_id, strict_terms, soft_terms, score, rejected) of every row; limit: the weight of a strict term, and the score from which a URL is rejected."""
    terms = dict(vocabulary() if terms is None else terms)
    automaton(terms)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(_run(terms, limit), SCHEMA)


def sql(terms: Mapping[str, int] | None = None, limit: int = STRICT) -> str:
    terms = vocabulary() if terms is None else terms

    def found(some: list[str]) -> str:
        cases = ", ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){re.escape(t)}($|[^a-z0-9])') THEN '{t}' END" for t in sorted(some))
        return f"list_filter([{cases}], lambda x: x IS NOT NULL)"

    weights = "MAP {" + ", ".join(f"'{t}': {w}" for t, w in terms.items()) + "}"
    return f"""
WITH folded AS (SELECT page_id, translate(url_decode(coalesce(url, '')), '{UPPER}', '{LOWER}') AS u FROM pages),
     found AS (SELECT page_id, {found([t for t, w in terms.items() if w >= limit])} AS strict_terms, {found([t for t, w in terms.items() if w < limit])} AS soft_terms FROM folded),
     scored AS (SELECT *, CAST(coalesce(list_sum(list_transform(strict_terms || soft_terms, lambda t: ({weights})[t])), 0) AS INTEGER) AS score FROM found)
SELECT page_id, strict_terms, soft_terms, score, score >= {limit} AS rejected FROM scored"""
