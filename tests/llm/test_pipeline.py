import random

import public_tokenizers
import pytest
from helpers import SCHEMA, awkward_docs, prose, shingles
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from shotweave.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, near copies, junk, a leak and awkward rows, with the tables that the stages read."""
    out = tmp_path_factory.mktemp("corpus")
    rnd = random.Random(3)
    clean = [(100 + i, prose(4000 + i, 160 + i)) for i in range(40)]
    leak = prose(90, 60)
    w = clean[0][1].split()
    w[80] = "other"
    rows = clean + [(300, " ".join(w)), (301, clean[1][1]), (302, "%%% ".join(prose(5, 200).split())), (303, prose(6, 200) + " " + leak + " " + prose(8, 100))]
    rows += [(304 + i, "$$$ ".join(prose(6000 + i, 150).split())) for i in range(30)]
    rnd.shuffle(rows)
    docs = [(d, t, "en", "s", len(t)) for d, t in rows] + awkward_docs()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(30)] + [(305 + i, 0, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == before.columns, name
        seen[name] = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
    assert {302, *range(304, 334), 3, 4, 5, 6} <= seen["quality"] and not seen["quality"] & set(range(100, 140))
    assert seen["lines"] == set()
    assert not seen["near_duplicates"] & set(range(100, 140)) - {100, 101} and seen["decontamination"] == {303}


def test_near_copies_at_the_stage_limit_go(spark, folder):
    """A passage of 45 words of 500 replaced: similarity between 0.80 and 0.85."""
    w = prose(77, 500, 900).split()
    v = [f"new{i}" if 240 <= i < 285 else x for i, x in enumerate(w)]
    a, b = shingles(" ".join(w)), shingles(" ".join(v))
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    docs = spark.createDataFrame([(1, " ".join(w), "en", "s", 0), (2, " ".join(v), "en", "s", 0), (3, prose(78, 300), "en", "s", 0)], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()} == {1, 3}


def test_run_gives_the_encoded_corpus(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert set(range(102, 140)) <= ids and not ids & {302, 303, 3, 4}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    text = {i: prose(4000 + i - 100, 160 + i - 100) for i in range(110, 115)}
    assert all(r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids) for r in rows if r.doc_id in text)


def test_stages_with_clashing_names_and_empty_tables(spark, folder):
    """Names that the stages use inside, as columns of the documents."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is null or doc_id < 110 or doc_id > 299")
    names = ["_gone", "_found", "_removed", "_doc", "_key", "kept", "removed", "score", "label_id"]
    extra = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    left = {"quality": {302, 304}, "lines": set(), "near_duplicates": {301}, "decontamination": {303}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, folder)
        assert got.columns == extra.columns, name
        ids = {r.doc_id for r in got.collect()}
        assert not ids & left[name] and {102, 105, 109} <= ids, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, extra, folder).count() == docs.count()


def test_every_operator_has_a_query():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) <= names and "pipeline" in names
