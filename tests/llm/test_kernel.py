import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm.common import NONSPACE, WORD, grams, slices


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é\n\t.,", max_size=30)), max_size=12), st.integers(1, 20))
def test_tokens_match_a_regular_expression(texts, size):
    for kind, pattern in ((WORD, r"[0-9A-Za-z\u0080-\U0010ffff]+"), (NONSPACE, r"[^ \t\n\r\f\v]+")):
        words, hashes = [], []
        for first, last, t in slices(pa.array(texts, pa.string()), kind, True, size):
            assert len(t.doc) == last - first + 1
            h = t.hash()
            for a, b in zip(t.doc[:-1], t.doc[1:]):
                words.append([bytes(t.buf[x:y]).decode() for x, y in zip(t.start[a:b], t.end[a:b])])
                hashes.append(h[a:b].tolist())
        assert words == [re.findall(pattern, x or "") for x in texts]
        seen = {}
        for w, h in zip(sum(words, []), sum(hashes, [])):
            fold = "".join(c.lower() if c.isascii() else c for c in w)
            assert seen.setdefault(fold, h) == h
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_grams(n):
    words = [[1, 2, 3, 1, 2], [], [7], [1, 2]]
    doc = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    g, at = grams(np.array(sum(words, []), np.uint64), doc, n)
    sizes = [max(len(w) - n + 1, min(len(w), 1)) for w in words]
    assert np.diff(at).tolist() == sizes
    if n == 2:
        assert g[0] == g[3] == g[at[3]] and len(set(g.tolist())) == 4
