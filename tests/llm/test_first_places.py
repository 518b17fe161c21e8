"""The first place of a passage stays where identifiers are null or repeat."""

import corpus_pipeline
import numpy as np
import pytest
from helpers import FOLDER, documents

from facetry.llm import suffixes


@pytest.mark.parametrize("name", [None, 4])
def test_equal_rows_keep_one_copy(spark, name):
    random = np.random.default_rng(10)
    text, other = ("".join(chr(97 + x) for x in random.integers(26, size=600)) for _ in range(2))
    rows = [(name, text), (name, text), (name, text), (9, "before " + text), (name, other), (name, other[50:] + " end")]
    found = suffixes.without_repeats(documents(spark, rows)).collect()
    kept = [bytes(r.kept).decode() for r in found]
    assert "".join(kept).count(text) == 1 and len(kept) == 6 and kept.count("") == 2 and "before " in kept
    assert len("".join(kept)) >= len(text) + len("before ") + 550 + len("end")
    alike = suffixes.without_repeats(documents(spark, rows), first_stays=False, characters=False).collect()
    assert not any(text in bytes(r.kept).decode() for r in alike)
    rows = corpus_pipeline.cut_repeats(spark, documents(spark, rows), FOLDER).collect()
    assert sorted(r.text for r in rows) == sorted(kept) and all(r.n_chars == len(r.text) for r in rows)
