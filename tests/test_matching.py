"""One-to-one matching by islands against plain greedy matching."""

import random

from pyspark.sql import functions as F

from dbpulse.operators import quality


def greedy(left, right, within):
    pairs = sorted((abs(a - b), i, j) for k, i, a in left for m, j, b in right if k == m and abs(a - b) <= within)
    ls, rs, out = set(), set(), []
    for gap, i, j in pairs:
        if i not in ls and j not in rs:
            ls.add(i)
            rs.add(j)
            out.append((i, j, gap))
    return sorted(out)


def matched(spark, left, right, within):
    got = quality.match_once(spark.createDataFrame(left, "key string, l_id long, l_s long"), spark.createDataFrame(right, "key string, r_id long, r_s long"), within)
    return sorted(tuple(r) for r in got.collect())


def test_nearest_pairs_are_plain_greedy():
    r = random.Random(11)
    for n in range(300):
        spread = r.choice([3, 20, 100])
        left = [("k", i, r.randrange(spread)) for i in range(r.randrange(12))]
        right = [("k", 100 + i, r.randrange(spread)) for i in range(r.randrange(12))]
        within = r.randrange(0, 15)
        rows = sorted([(s, 0, i) for _, i, s in left] + [(s, 1, i) for _, i, s in right])
        assert sorted(quality.nearest_pairs(rows, within)) == greedy(left, right, within), n


def test_matching_by_key_and_ties(spark):
    r = random.Random(12)
    left = [(r.choice("ab"), i, r.randrange(900)) for i in range(150)] + [(None, 900, 1)]
    right = [(r.choice("ab"), 1000 + i, r.randrange(900)) for i in range(150)] + [(None, 1900, 1), ("a", 1901, None)]
    assert matched(spark, left, right, 12) == greedy([x for x in left if x[0]], [x for x in right if x[0] and x[2] is not None], 12)


def test_a_chain_of_falling_gaps_takes_one_pass(spark):
    """1,000 rows, each nearer to the next than to the one before: rounds of mutual nearest would be as many."""
    at, left, right = 0, [], []
    for i in range(1000):
        (left if i % 2 else right).append(("k", i, at))
        at += 2000 - i
    assert matched(spark, left, right, 2000) == greedy(left, right, 2000)
    assert matched(spark, left, [], 5) == []


def test_findings_match_by_their_set_of_processes(spark):
    rows = spark.createDataFrame([("d", [3, 1, 3]), ("d", [1, 3]), ("e", [1, 3]), ("d", []), ("d", None)], "db_id string, pids array<long>")
    assert [r.key for r in quality.process_key(rows).collect()] == ["d|1,3", "d|1,3", "e|1,3", None, None]
