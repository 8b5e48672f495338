from collections import Counter

import pytest

from shotweave.plans import registry
from shotweave.sources.tables import exemplars


def cosine(a, b):
    x, y = Counter(a.split(" ")), Counter(b.split(" "))
    return sum(v * y[w] for w, v in x.items()) / (sum(v * v for v in x.values()) ** 0.5 * sum(v * v for v in y.values()) ** 0.5)


@pytest.mark.parametrize("name,other_text", [("filter_cross_domain", False), ("filter_same_question", True)])
def test_every_exemplar_is_a_target(spark, tmp_path, name, other_text):
    registry.load_all()
    spark.createDataFrame([(i, i * 7 % 30) for i in range(1, 45)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = [(r.ex_id, r.db_id, r.question) for r in exemplars(spark, str(tmp_path)).collect()]
    expected = set()
    for t, db, text in rows:
        found = sorted((-round(cosine(text, q), 12), c) for c, d, q in rows if d != db and not (other_text and q == text))
        expected |= {(t, c, round(-s, 6), rk) for rk, (s, c) in enumerate(found[:5], 1)}
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.target_id, r.cand_id, r.score, r.rk) for r in got} == expected
    assert {r.target_id for r in got} == {t for t, _, _ in rows}
