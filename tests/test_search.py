import itertools
import random

import pytest

from numeriq.plans.search import FAIL, PASS, UNRESOLVED, Search


def causes(*sets):
    return lambda s: FAIL if any(set(c) <= s for c in sets) else PASS


def test_smallest_failing_is_minimal_among_all_subsets():
    rng = random.Random(1)
    for _ in range(60):
        items = list(range(9))
        bad = [rng.sample(items, rng.randrange(1, 4)) for _ in range(3)]
        test = causes(*bad)
        found = Search(test).smallest_failing(items)
        assert test(found) == FAIL and all(test(frozenset(c)) == PASS for k in range(len(found)) for c in itertools.combinations(found, k))
        most = Search(test).largest_passing(items)
        assert test(most) == PASS and all(test(most | {x}) == FAIL for x in items if x not in most)
        low, high = Search(test).difference(items)
        assert test(low) == PASS and test(high) == FAIL and low < high and len(high - low) == 1


def test_the_index_spares_tests():
    items = list(range(16))
    plain, spare = Search(causes([3, 11])), Search(causes([3, 11]), monotone=True)
    assert plain.smallest_failing(items) == spare.smallest_failing(items) == {3, 11}
    assert spare.runs < plain.runs and spare.spared > 0
    runs = spare.runs
    assert spare.smallest_failing(items) == {3, 11} and spare.runs == runs


def test_unresolved_candidates_are_repaired_by_a_hook():
    """Items come in pairs (k, k + 8): half a pair can't be run."""
    items = list(range(16))

    def test(s):
        if any((k in s) != (k + 8 in s) for k in range(8)):
            return UNRESOLVED
        return FAIL if 5 in s else PASS

    def complete(candidate, low, high):
        return frozenset(x for k in candidate for x in (k % 8, k % 8 + 8))

    seen = []
    fixed = Search(test, resolve=complete, report=lambda low, high: seen.append((low, high)))
    assert fixed.smallest_failing(items) == {5, 13} and seen
    low, high = Search(test, resolve=complete).difference(items)
    assert test(low) == PASS and test(high) == FAIL and high - low == {5, 13}
    assert test(Search(test).smallest_failing(items)) == FAIL


@pytest.mark.parametrize("items", [[], [1]])
def test_ends(items):
    assert Search(lambda s: PASS).smallest_failing(items) == frozenset() and Search(lambda s: PASS).largest_passing(items) == frozenset(items)
    assert Search(lambda s: FAIL if s else PASS).smallest_failing([1]) == {1} and Search(lambda s: FAIL if s else PASS).largest_passing([1]) == frozenset()
    assert Search(lambda s: FAIL if len(s) == 2 else PASS, split=lambda x, n: [[i] for i in x]).difference([1, 2])[1] == {1, 2}


def test_columns_that_break_a_result(spark):
    from pyspark.sql import functions as F

    from numeriq.plans import tuner

    df = spark.createDataFrame([(i % 3, 1000.0 + i / 7, 0.5 + (i % 4) / 4, 1.0 + i % 8) for i in range(90)], "g long, a double, b double, c double")
    query = lambda t: t.groupBy("g").agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.sum("c").alias("t"))
    found, search = tuner.breaking_columns(df, query, ["a", "b", "c"], ["g"], ["s", "t"], 6, "h")
    # b and c are exact in half precision, a isn't.
    assert [(r["column"], set(r["beside"]) <= {"b", "c"}) for r in found.collect()] == [("a", True)] and search.runs <= 6
    plain, spare = (tuner.tune(df, query, ["a", "b", "c"], ["g"], ["s", "t"], 6, "hsd", monotone=m) for m in (False, True))
    assert spare.formats == plain.formats and spare.runs <= plain.runs
