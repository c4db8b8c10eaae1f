"""The pipeline against stage-by-stage brute force."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import decontam, pii, queries
from tests.llm.test_nearcopies import grams
from tests.llm.test_operators import brute_edit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs.collect(), new.collect(), new.columns))
        docs = new
    return {x[0]: x[1:] for x in out}


def test_stages_return_documents(stages):
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == corpus_pipeline.COLUMNS, name


def test_language_keeps_all_with_a_language(stages):
    before, after, _ = stages["language"]
    kept = {r["doc_id"] for r in after}
    assert {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")} == kept


def test_one_of_each_group_stays(stages):
    """Groups of texts whose 5-word shingle sets have a Jaccard similarity of 0.8 or more, closed under chains."""
    before, after, _ = stages["near_duplicates"]
    sets, least = {r["doc_id"]: grams(r["text"]) for r in before}, {r["doc_id"]: r["doc_id"] for r in before}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(10):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert sorted(r["doc_id"] for r in after) == sorted(d for d in least if least[d] == d) and len(after) < len(before)


def test_leaks_go_and_clean_documents_stay(spark, stages):
    before, after, _ = stages["benchmark_leaks"]
    words = lambda t: decontam.words_of([t])[0].tolist()
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for r in before:
        text = words(r["text"])
        near = [i for i in items if len(set(i) & set(text)) >= 0.6 * len(set(i))]  # a leak has far more words in common
        if all(brute_edit(i, text) > int(0.2 * len(i)) for i in near):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in after} == clean and len(clean) < len(before)


def test_personal_data_is_rewritten(spark, stages):
    before, after, _ = stages["personal_data"]
    key = hashlib.blake2b(queries.pseudonym_key(spark).encode()).digest()
    assert {r["doc_id"]: r["text"] for r in after} == {r["doc_id"]: pii.pseudonymise(r["text"], key)[0] for r in before}
    assert any(a["text"] != b["text"] for a, b in zip(sorted(before), sorted(after)))


def test_tokens_are_the_librarys(stages):
    from tokenizers import Tokenizer

    before, after, _ = stages["tokens"]
    library = Tokenizer.from_file(queries.TOKENIZER)
    assert {r["doc_id"]: r["ids"] for r in after} == {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in before}


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in got.collect()) == collections.Counter((r["doc_id"], r["ids_sha256"]) for r in stages["tokens"][1])
    assert not set(corpus_pipeline.COLUMNS) - {"text", "n_chars"} - set(got.columns)


def test_repeated_and_missing_ids(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long), (1, long), (2, long), (None, long), (None, "quite another text without an id"), (None, "quite another text without an id"), (5, "a third text that stands alone"), (5, "a third text that stands alone"), (6, None), (7, "")]
    docs = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("fingerprint", F.lit(0))
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, "quite another text without an id"), (1, long), (5, "a third text that stands alone"), (6, "")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows) and stage(spark, docs.limit(0), SF).count() == 0
