import itertools
import random

from pyspark.sql import functions as F

from shotweave.operators import evaluate as ev
from shotweave.operators import resultmatch

SCHEMA = "task_id long, cand_id string, row_no long, vals array<string>"
CYCLE = [(i, (i + 1) % 6) for i in range(6)]
TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]


def incidence(edges, width, order=None):
    order = order or list(range(width))
    return [["1" if order.index(c) in e else "0" for c in range(width)] for e in edges]


def table(spark, results):
    return spark.createDataFrame([(t, c, i, r) for (t, c), rows in results.items() for i, r in enumerate(rows)], SCHEMA)


def brute(a, b):
    if not a and not b:
        return True
    if len(a) != len(b) or len(a[0]) != len(b[0]):
        return False
    key = lambda rows: sorted(rows, key=str)
    return any(key([[r[i] for i in p] for r in b]) == key(a) for p in itertools.permutations(range(len(a[0]))))


def equal(df):
    return {(r.task_id, r.cand_a, r.cand_b): r.equal for r in df.collect()}


def test_cycle_is_no_two_triangles(spark):
    """Six columns that no colouring tells apart."""
    results = {(1, "a"): incidence(CYCLE, 6), (1, "b"): incidence(TRIANGLES, 6), (1, "c"): incidence(CYCLE, 6, [3, 0, 5, 1, 4, 2])[::-1], (1, "d"): incidence(TRIANGLES, 6, [5, 0, 3, 1, 2, 4])}
    df = table(spark, results)
    assert equal(ev.result_equal(df)) == {(1, a, b): (a + b) in ("ac", "bd") for a, b in itertools.combinations("abcd", 2)}
    cands = spark.createDataFrame([(1, c, i, True) for i, c in enumerate("bacd")] + [(1, "e", 9, True)], "task_id long, cand_id string, cand_no int, runnable boolean")
    vote = ev.vote_by_result(df, cands).first()
    assert (vote.chosen, vote.group_size) == ("b", 2)
    assert len({r.fp for r in ev.result_fingerprints(df, cands).collect()}) == 3
    assert [ev.execution_accuracy(df, pred=p, gold="a").first().accuracy for p in "cd"] == [1.0, 0.0]


def test_wide_symmetric_results_keep_few_branches(spark):
    """Twelve columns, each alike: 12! mappings, and the first one that is tried to the end fits."""
    one = [["1" if c == i else "0" for c in range(12)] for i in range(12)]
    assert equal(ev.result_equal(table(spark, {(1, "a"): one, (1, "b"): one[::-1]}))) == {(1, "a", "b"): True}


def test_large_results_are_searched_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(resultmatch, "LOCAL_CELLS", 0)
    monkeypatch.setattr(resultmatch, "BRANCHES", 3)
    results = {(1, "a"): incidence(CYCLE, 6), (1, "b"): incidence(TRIANGLES, 6), (1, "c"): incidence(CYCLE, 6, [3, 0, 5, 1, 4, 2])[::-1]}
    assert equal(ev.result_equal(table(spark, results))) == {(1, "a", "b"): False, (1, "a", "c"): True, (1, "b", "c"): False}


def test_random_tables_against_all_permutations(spark):
    rnd = random.Random(4)
    results = {}
    for t in range(40):
        width = rnd.randrange(1, 6)
        base = [[rnd.choice(["0", "1", None] if t % 3 else ["0", "1"]) for _ in range(width)] for _ in range(rnd.randrange(1, 7))]
        p = rnd.sample(range(width), width)
        turned = [[r[i] for i in p] for r in base]
        rnd.shuffle(turned)
        other = [r[:] for r in turned]
        i, j = rnd.randrange(len(other)), rnd.randrange(len(other))
        other[i][0], other[j][0] = other[j][0], other[i][0]
        results |= {(t, "a"): base, (t, "b"): turned, (t, "c"): other}
    got = equal(ev.result_equal(table(spark, results)))
    want = {(t, a, b): brute(results[t, a], results[t, b]) for t in range(40) for a, b in itertools.combinations("abc", 2)}
    assert got == want and len(set(want.values())) == 2


def test_ordered_identical_columns_and_forms_of_numbers(spark):
    df = table(spark, {(1, "a"): [["1", "1.0", "x"], ["2", "2", "y"]], (1, "b"): [["y", "2", "2.00"], ["x", "1e0", "1"]], (2, "a"): [[]], (2, "b"): [[]], (2, "c"): [[], []]})
    assert equal(ev.result_equal(df)) == {(1, "a", "b"): True, (2, "a", "b"): True, (2, "a", "c"): False, (2, "b", "c"): False}
    assert equal(ev.result_equal(df, ordered=True))[1, "a", "b"] is False
    assert ev.result_equal(df.where(F.lit(False))).count() == 0
