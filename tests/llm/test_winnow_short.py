"""The default window is dense enough for short texts."""

from graphloom.llm import winnow
from graphloom.llm.winnow import Winnow


def test_short_texts_are_near_their_edits(spark, make_docs, prose):
    rows = [(i, prose(60, i)[: 32 + i]) for i in range(224)]
    got = winnow.compare_edited(make_docs(rows)).collect()
    assert len(got) == len(rows)
    assert all(r.near_edited > r.near_next for r in got)


def test_short_shared_passage_is_found(prose):
    how = Winnow()
    for seed in range(50):
        passage = prose(60, seed)[:32]
        a, b = (winnow.fingerprint(winnow.code_points(prose(50, s) + passage + prose(70, s)), how) for s in (seed + 100, seed + 200))
        places = [{int(x) >> 32 for x in winnow.fingerprint(winnow.code_points(passage), how)}, *({int(x) >> 32 for x in y} for y in (a, b))]
        assert set.intersection(*places)
