"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from rasterloom.llm import nearcopies, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def planted():
    luck = random.Random(4)
    words = ["".join(luck.choice("abcdefghijklm") for _ in range(luck.randrange(2, 8))) for _ in range(3000)]
    texts = []
    for _ in range(40):
        text = [luck.choice(words) for _ in range(luck.randrange(60, 400))]
        texts.append(" ".join(text))
        for _ in range(6):  # copies around the least similarity, some of copies
            text = list(text)
            for _ in range(max(1, len(text) // luck.choice([45, 60, 90]))):
                text[luck.randrange(len(text))] = luck.choice(words)
            texts.append(" ".join(text).capitalize())
    return dict(enumerate(texts)) | {900: None, 901: "", 902: "One two", 903: "one  TWO"}


def test_near_copies_equal_brute_force(spark, monkeypatch):
    texts = planted()
    sets, least = {d: grams(t) for d, t in texts.items()}, {d: d for d in texts}
    pairs = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(10):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    far = [p for p in pairs if (simhash.fingerprint(texts[p[0]]) ^ simhash.fingerprint(texts[p[1]])).bit_count() > simhash.RADIUS]
    assert len(far) > 50  # four bits of SimHash leave these
    docs = spark.createDataFrame([(d, t, "en", None, None) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    for block, held in ((nearcopies.BLOCK, nearcopies.BLOCK_SHINGLES), (2, nearcopies.BLOCK_SHINGLES), (nearcopies.BLOCK, 500)):
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        monkeypatch.setattr(nearcopies, "BLOCK_SHINGLES", held)
        got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
        assert got == sorted(d for d in least if least[d] == d)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "one two three four five six", 10), (2, "one two three four five six", 20), (3, "quite another text", 30)]
    names = ["digest", "f0", "f1", "size", "root", "node", "one", "two", "own", "other", "blocks", "first"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v int").selectExpr("doc_id", "text", *[f"v + {k} AS {n}" for k, n in enumerate(names)])
    got = nearcopies.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in docs.where("doc_id <> 2").collect())
