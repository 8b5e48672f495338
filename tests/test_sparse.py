import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shotweave.operators import sparse
from shotweave.operators.skeletons import overlapping_skeletons, similar_skeletons
from shotweave.operators.sparse import sparse_topk

SCHEMA = "id long, domain string, body string, text string, skel string"


def jaccard(a, b):
    x, y = Counter(a.strip().split(" ")), Counter(b.strip().split(" "))
    shared = sum((x & y).values())
    return shared / (sum(x.values()) + sum(y.values()) - shared)


@pytest.fixture(scope="module")
def rows():
    """Few words and many ties, words that occur once, a domain with most rows, texts without common words."""
    rnd = random.Random(8)
    words = list("abcdefgh") + [f"r{i}" for i in range(30)]
    skels = [" ".join(rnd.choice("xyz_") for _ in range(12)) for _ in range(6)]
    skels += [s.replace("x", "y", 1) for s in skels]
    out = []
    for i in range(150):
        body = " ".join(rnd.choice(words[:3 + i % 36]) for _ in range(1 + i % 5))
        out.append((i * 7, "hot" if i % 3 else f"d{i % 5}", body, f"q {rnd.randrange(20)}", rnd.choice(skels)))
    return out + [(5000 + i, "hot", "alone", "q", skels[0]) for i in range(30)] + [(6000, "d1", "zz", None, None)]


def brute(rows, k, metric, same_text, rule):
    out = []
    count = {r[0]: Counter(r[2].split(" ")) for r in rows}
    norm = {i: sum(v * v for v in c.values()) for i, c in count.items()}
    for t in rows:
        found = []
        for c in rows:
            if t[1] == c[1] or same_text and (t[3] or "") == (c[3] or ""):
                continue
            dot = sum(v * count[c[0]][w] for w, v in count[t[0]].items())
            score = (norm[t[0]] + norm[c[0]] - 2 * dot) ** 0.5 if metric == "euclid" else dot / (norm[t[0]] ** 0.5 * norm[c[0]] ** 0.5)
            passes = rule and jaccard(t[4] or "", c[4] or "") >= 0.85
            if rule != "strict" or passes:
                found.append((0 if passes or not rule else 1, round(score if metric == "euclid" else -score, 12), c[0], round(score, 6)))
        out += [(t[0], c, s, r) for r, (_, _, c, s) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("metric,same_text,rule", [("euclid", False, None), ("cosine", True, None), ("euclid", False, "backfill"), ("euclid", False, "strict")])
def test_equals_all_pairs(spark, rows, metric, same_text, rule):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sparse_topk(df.withColumnRenamed("id", "target_id"), df.withColumnRenamed("id", "cand_id"), 4, metric=metric, exclude_same_text=same_text, skeleton_rule=rule)
    assert sorted((r.target_id, r.cand_id, r.score, r.rk) for r in got.collect()) == brute(rows, 4, metric, same_text, rule)


@pytest.mark.parametrize("metric,same_text,rule", [("euclid", False, None), ("cosine", True, None), ("cosine", False, None), ("euclid", False, "backfill"), ("euclid", False, "strict")])
def test_classes_of_common_words_equal_all_pairs(spark, rows, metric, same_text, rule, monkeypatch):
    monkeypatch.setattr(sparse, "RARE", 6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sparse_topk(df.withColumnRenamed("id", "target_id"), df.withColumnRenamed("id", "cand_id"), 3, metric=metric, exclude_same_text=same_text, skeleton_rule=rule)
    assert sorted((r.target_id, r.cand_id, r.score, r.rk) for r in got.collect()) == brute(rows, 3, metric, same_text, rule)


def test_similar_skeletons_against_all_pairs(spark):
    rnd = random.Random(2)
    skels = sorted({" ".join(rnd.choice(["select", "_", ",", "from", "where", "=", "and"]) for _ in range(rnd.randrange(1, 25))) for _ in range(120)} | {" select _ "})
    skels += [s + " _" for s in skels[:60]]
    df = spark.createDataFrame([(s,) for s in skels] + [(None,)], "skel string")
    for threshold in (0.85, 0.5):
        got = {(r.t_skel, r.c_skel): round(r.jaccard, 9) for r in similar_skeletons(df, df, threshold).collect()}
        assert got == {(a, b): round(jaccard(a, b), 9) for a in set(skels) for b in set(skels) if jaccard(a, b) >= threshold}
    every = {(r.t_skel, r.c_skel): round(r.jaccard, 9) for r in overlapping_skeletons(df.where(F.col("skel").isNotNull()), df.where(F.col("skel").isNotNull())).collect()}
    assert every == {(a, b): round(jaccard(a, b), 9) for a in set(skels) for b in set(skels) if jaccard(a, b) > 0}


def test_classes_do_not_multiply_by_skeletons(spark, monkeypatch):
    """Texts of equal common words are one class, however many skeletons they have."""
    monkeypatch.setattr(sparse, "RARE", 6)
    seen, lists = [], sparse._class_lists

    def counted(class_dots, *rest):
        seen.append(class_dots.count())
        return lists(class_dots, *rest)

    monkeypatch.setattr(sparse, "_class_lists", counted)
    rows = [(i, f"d{i % 2}", "how many rows", "", f"a{i} b{i} c{i}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sparse_topk(df.withColumnRenamed("id", "target_id"), df.withColumnRenamed("id", "cand_id"), 3, skeleton_rule="backfill")
    assert sorted((r.target_id, r.cand_id, r.score, r.rk) for r in got.collect()) == brute(rows, 3, "euclid", False, "backfill")
    assert set(seen) == {1}
