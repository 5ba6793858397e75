"""A leader of a third of all texts is cut into parts, and no pair is lost or doubled."""

import random

from pyspark.sql import functions as F

from docloom.llm import minhash


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(80)]
    near = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(80)] = word()
        near.append((i, " ".join(own)))
    return near + [(100 + i, " ".join(word() for _ in range(40))) for i in range(120)]


def test_a_large_leader_is_many_keys(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), "doc_id long, text string").repartition(4)
    seen = []
    real = minhash.stars

    def cut(member):
        star = real(member, 5)
        seen.append(star.collect())
        return star

    monkeypatch.setattr(minhash, "stars", cut)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{i: i for i in range(100, 220)}}
    pairs = [(max(r.lead, r.node), min(r.lead, r.node)) for r in seen[0]]
    assert len(pairs) == len(set(pairs)) >= 59
    lead = max({r.lead for r in seen[0]}, key=lambda x: sum(r.lead == x for r in seen[0]))
    own = [r for r in seen[0] if r.lead == lead]
    assert len({r.parts for r in own}) == 1 and own[0].parts >= len(own) / 5


def test_stars_meet_every_member_of_a_bucket(spark):
    rows = [(0, 7, 9, n) for n in range(9)] + [(1, 7, 3, n) for n in (2, 20, 21)] + [(1, 8, 2, n) for n in (20, 2)]
    member = spark.createDataFrame(rows, "band int, at long, n long, node long")
    for most in (1, 2, 4096):
        got = sorted((r.lead, r.node) for r in minhash.stars(member, most).select("lead", "node", F.col("parts")).collect())
        # node 2 has most company in every bucket
        assert got == [(2, n) for n in (0, 1, 3, 4, 5, 6, 7, 8, 20, 21)]
