"""Sets of a token meet only where it can be the first one in common, and a longer set that holds a shorter one is not lost."""
from curvekit.llm import ngram_join


def asked(spark, tokens, groups):
    members, queries = ngram_join.cross_blocks(spark.createDataFrame(tokens, "token long, a long, rest int"),
                                               spark.createDataFrame([(*g, bytearray(8)) for g in groups], "a long, grp long, n long, w long, bits binary"), 75)
    return sorted((q["grp"], q["a"]) for q in queries.collect()), sorted((m["grp"], m["a"]) for m in members.collect())


def test_longer_set_around_a_shorter_one(spark):
    # 300 and 390 tokens, 296 in common (296 / 394 > 75 %); the 94 rarest of the longer one leave 4 common ones in its prefix of 98, the shorter one's prefix has 76
    for short, long in ((1, 2), (2, 1)):
        tokens = [(t, short, 300 - t) for t in range(4)] + [(t, long, 296 - t) for t in range(4)]
        got = asked(spark, tokens, [(short, short, 300, 300 - 76 + 4), (long, long, 390, 390 - 98 + 4)])
        assert got == ([(2, 1)], [(2, 2)])


def test_late_tokens_do_not_meet(spark):
    groups = [(a, a, 400, 400) for a in range(1, 9)]
    assert asked(spark, [(7, a, 342) for a in range(1, 9)], groups) == ([], [])  # 343 of 457 are 75 %
    assert len(asked(spark, [(7, a, 343) for a in range(1, 9)], groups)[0]) == 28
