"""Operators that learn from or look at the whole corpus, not at a part of it."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import frame, prose
from trackloom.llm import hmm


def test_language_model_learns_from_all_rows(spark, monkeypatch):
    """From a start on three documents, rounds go on until the likelihood of all rows settles, near that of a start on all."""
    rng = random.Random(4)
    kinds = [["the", "on", "er", "ing"], ["que", "la", "no", "ji"], ["zu", "ka", "mo", "ri"]]
    rows = [(i, prose(rng, kinds[i % 3], 60), None, None, None) for i in range(150)]
    totals, plain = [], hmm.full_round
    monkeypatch.setattr(hmm, "full_round", lambda *a: totals.append(plain(*a)) or totals[-1])
    score = lambda sample: hmm.score(frame(spark, rows), F.lit(False), sample=sample, states=3).agg(F.sum("score")).first()[0]
    small = score(3)
    rises = [(b.total - a.total) / abs(a.total) for a, b in zip(totals, totals[1:])]
    assert len(totals) > 2 and rises[-1] <= 1e-3 and all(r > 1e-3 for r in rises[:-1])
    assert small == pytest.approx(score(150), rel=0.05)
