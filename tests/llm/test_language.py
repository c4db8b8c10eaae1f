"""The pipeline's language stage on documents in no known language, beside clean and code-switched ones."""

import random

import corpus_pipeline
from rasterloom.llm import langid

SF = "/root/testdata/sf0.01"
SAID = {
    "ru": "в начале было слово и слово было у бога и слово было бог оно было в начале у бога все через него начало быть",
    "el": "εν αρχη ην ο λογος και ο λογος ην προς τον θεον και θεος ην ο λογος ουτος ην εν αρχη προς τον θεον",
    "zh": "太初有道 道与神同在 道就是神 这道太初与神同在 万物是借着他造的 凡被造的 没有一样不是借着他造的",
    "ar": "في البدء كان الكلمة والكلمة كان عند الله وكان الكلمة الله هذا كان في البدء عند الله كل شيء به كان",
    "fi": "alussa oli sana ja sana oli jumalan luona ja sana oli jumala hän oli alussa jumalan luona kaikki syntyi sanan voimalla",
    "pl": "na początku było słowo a słowo było u boga i bogiem było słowo ono było na początku u boga wszystko przez nie się stało",
}


def rejected(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + k, t, None, "extra", len(t)) for k, t in enumerate(rows)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(extra), SF).select("doc_id").collect()}
    clean = {r["doc_id"] for r in docs.select("doc_id").collect()}
    return [10**6 + k not in kept for k in range(len(rows))], len(clean - kept)


def test_documents_in_no_known_language_go_and_clean_ones_stay(spark):
    luck = random.Random(1)
    foreign = [" ".join(luck.choices(t.split(), k=luck.randrange(8, 20))) for t in SAID.values() for _ in range(10)]
    noise = [" ".join("".join(luck.choices("abcdefghijklmnopqrstuvwxyz", k=luck.randrange(3, 10))) for _ in range(luck.randrange(8, 60))) for _ in range(40)]
    known = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND length(text) > 400").orderBy("doc_id").limit(60).collect()]
    switched = [" ".join(a.split()[:30] + b.split()[:30]) for a, b in zip(known[::2], known[1::2])]
    gone, lost = rejected(spark, foreign + noise + switched + ["", "12 34"])
    assert sum(gone[:60]) >= 54 and sum(gone[60:100]) >= 36
    assert not any(gone[100:130]) and all(gone[130:]) and lost == 0


def test_runs_of_code_switched_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    texts = {r["lang"]: langid.words_of(r["text"])[:40] for r in docs.where("lang IS NOT NULL AND length(text) > 600").orderBy("doc_id").collect()}
    said = [(lang, w) for lang in ("en", "fr", "de") for w in texts[lang]]
    rows = spark.createDataFrame([(1, " ".join(w for _, w in said)), (2, None), (3, "7")], "doc_id long, text string")
    got = {r["doc_id"]: r["runs"] for r in langid.predict(rows, model, runs=True).collect()}
    assert got[2] == got[3] == []
    labels = [r["lang"] for r in got[1] for _ in range(r["words"])]
    assert [r["first"] for r in got[1]] == [sum(x["words"] for x in got[1][:k]) for k in range(len(got[1]))]
    assert len(labels) == len(said) and sum(a == b for a, (b, _) in zip(labels, said)) >= 0.9 * len(said)
