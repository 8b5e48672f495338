import zlib
from collections import Counter

import numpy as np
from helpers import SCHEMA, awkward_docs, prose, words

from shotweave.llm import language_id, quality_rules
from shotweave.llm.textbatch import find_words, hash_ngrams, hash_words

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, repeat = len(w), len(inside)
    return (n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, repeat, n < 50 or 100 * repeat > 50 * n)


def test_base_columns_match_brute_force(spark, clashing):
    more = [(20, "a b c a b c x#% \n a b\n a b\n\n\n", "", "", 0), (21, "x y z " * 40, "", "", 0), (22, "w v u\x85t\x1cs é|<>&$*#%", "", "", 0)]
    labels = spark.createDataFrame([(0, 1, 0), (9, 1, 0), (11, 0, 0), (None, 1, 0), (0, 1, 0)], LABELS)
    rows = quality_rules.judge(threshold=-0.09, labels=labels, docs=clashing.select("doc_id", "text", "key", "words", "score").unionByName(
        spark.createDataFrame([(d, t) for d, t, *_ in more], "doc_id long, text string"), allowMissingColumns=True)).collect()
    assert len(rows) == len(awkward_docs()) + 3
    texts = {d: t for d, t, *_ in awkward_docs() + more}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed and r.score >= -0.09)


def test_score_is_the_mean_log_ratio(spark):
    good, bad = [prose(i, 200) for i in range(30)], ["%% ".join(prose(100 + i, 200).split()) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(good + bad)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(0, 60, 2)], LABELS)
    rows = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(rows[i].kept for i in range(30)) and not any(rows[i].kept for i in range(30, 60))
    ratio = quality_rules.log_ratios(docs, labels)
    assert ratio.shape == (1 << quality_rules.BUCKET_BITS,) and np.isfinite(ratio).all()
    few = quality_rules.judge(docs, labels, max_trusted=3).collect()  # the bound is a parameter
    assert len(few) == 60


def grams(text):
    """Buckets of the 1- and 2-grams of a text, word by word."""
    def bucket(some, n):
        data = np.frombuffer(" ".join(some).encode(), dtype=np.uint8)
        found = find_words(data, np.array([0, len(data)]))
        h = hash_words(data, found)
        return int((h if n == 1 else hash_ngrams(h, found, 2, short=False)[0])[0] >> np.uint64(64 - quality_rules.BUCKET_BITS))
    w = words(text)
    return [bucket([x], 1) for x in w] + [bucket(p, 2) for p in zip(w, w[1:])]


def test_scores_and_verdicts_match_brute_force(spark):
    """Every count, ratio, mean and the threshold, one n-gram at a time."""
    texts = {i: prose(i, 70 + i) if i < 24 else "%% ".join(prose(500 + i, 60 + i).split()) for i in range(40)} | {90: "short", 91: None}
    quality = {i: int(i < 24) for i in range(0, 40, 2)} | {91: 1}
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()] + [(4, None, 0), (None, 1, 0)], LABELS)
    teach = {r.label_id for r in quality_rules._labelled(labels).filter("learn and quality = 1").collect()}
    assert 2 < len(teach) < 12
    size = 1 << quality_rules.BUCKET_BITS
    corpus, trusted = Counter(), Counter()
    for i, t in texts.items():
        corpus.update(grams(t))
        if i in teach:
            trusted.update(grams(t))
    p = [lambda b, c=c, n=sum(c.values()): (c[b] + quality_rules.SMOOTHING * n / size) / (n * (1 + quality_rules.SMOOTHING)) for c in (trusted, corpus)]
    score = {i: float(np.mean([np.log(p[0](b)) - np.log(p[1](b)) for b in grams(t)])) if words(t) else 0.0 for i, t in texts.items()}
    rows = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert rows[0].asDict().keys() == {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"}
    assert list(rows[0].asDict())[-2:] == ["kept", "score"]
    for i, r in rows.items():
        assert abs(r.score - score[i]) < 1e-5, i
    bins = {k: [int(np.floor(rows[i].score / quality_rules.BIN)) for i, q in quality.items() if q == k and not rows[i].base_failed and (k == 0 or i not in teach)] for k in (0, 1)}
    edges = range(min(bins[0] + bins[1]), max(bins[0] + bins[1]) + 2)
    gain = [np.mean([b < e for b in bins[0]]) - np.mean([b < e for b in bins[1]]) for e in edges]
    best = [e for e, g in zip(edges, gain) if g >= max(gain) - 1e-12]
    last = next(e for e in best if e + 1 not in best)
    threshold = (best[0] + last) / 2 * quality_rules.BIN
    assert all(r.kept == (not r.base_failed and r.score >= threshold) for r in rows.values()) and {r.kept for r in rows.values()} == {True, False}


def test_threshold_uses_all_labels_and_one_kind_alone(spark):
    scored = spark.createDataFrame([(i, False, i / 100) for i in range(200)], "doc_id long, base_failed boolean, score double")
    good = spark.createDataFrame([(i, 1, 0) for i in range(100, 200)], LABELS)
    bad = spark.createDataFrame([(i, 0, 0) for i in range(100)], LABELS)
    assert 0.9 < quality_rules.calibrated_threshold(scored, good.union(bad)) <= 1.03
    assert 1.0 <= quality_rules.calibrated_threshold(scored, good) <= 1.1
    assert 0.99 < quality_rules.calibrated_threshold(scored, bad) <= 1.0
    assert quality_rules.calibrated_threshold(scored, bad.limit(0)) == -np.inf


def test_no_labels_and_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    assert all(r.score == 0 for r in quality_rules.judge(docs, none).collect())
    assert quality_rules.judge(empty, none).count() == 0


def test_languages_are_learned_and_held_out(spark):
    letters = {"aa": "ka lo mi ter", "bb": "öß üng sch ät", "cc": "ño ció és ll"}
    rows = [(i, " ".join(letters[lang].split()[(i * 7 + k * k) % 4] for k in range(60)), lang, "s", 0) for i in range(90) for lang in [sorted(letters)[i % 3]]]
    rows += [(200, None, "aa", "", 0), (201, "12 34 !?", "aa", "", 0), (202, "", "aa", "", 0), (203, "ka lo", None, "", 0), (None, "ño ció", "cc", "", 0), (204, "KA LO MI" * 9000, "aa", "", 0)]
    out = {r.doc_id: r for r in language_id.train_and_identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    for d, t, lang, *_ in rows:
        r = out[d]
        assert r.held_out == (zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if d in (200, 201, 202):
            assert r.lang_pred == "und" and r.score == 0
        else:
            assert r.lang_pred == (lang or "aa")


def test_language_without_training(spark, empty):
    one = spark.createDataFrame([(1, "text", None, "", 0)], SCHEMA)
    assert [r.lang_pred for r in language_id.train_and_identify(one).collect()] == ["und"]
    assert language_id.train_and_identify(empty).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.train_and_identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").dropna()
    assert out.filter("lang = lang_pred").count() >= 0.98 * out.count()
