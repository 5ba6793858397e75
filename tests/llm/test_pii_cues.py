"""Cues count in any case that their patterns allow."""

import pytest

from docloom.llm import pii

TEXTS = {"TOKEN = 0123456789abcdef0123": "secret", "API_KEY=0123456789abcdef0123": "secret", "Password: 0123456789abcdef0123": "secret", "Name: Ann Lee": "name", "Name is Ann Lee": "name", "Dr. Ann Lee": "name"}


@pytest.mark.parametrize("low", [False, True])
def test_cues_in_any_case(spark, low):
    rows = [(i, t if not low else t[0].lower() + t[1:] if k == "name" and "Dr" not in t else t) for i, (t, k) in enumerate(TEXTS.items())]
    got = {r.doc_id: [pii.KINDS[s.kind] for s in r.spans] for r in pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [k] for i, k in enumerate(TEXTS.values())}
