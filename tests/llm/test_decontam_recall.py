"""Leaks at the largest allowed distance, by the item's length."""

import random

import pytest

from rasterloom.llm import decontam
from tests.llm.test_operators import brute_edit


@pytest.mark.parametrize("size", [8, 20, 60, 150, 300])
def test_recall_at_the_largest_distance(size):
    luck = random.Random(size)
    words = ["".join(luck.choice("abcdefghijk") for _ in range(luck.randrange(3, 8))) for _ in range(900)]
    say = lambda n: [luck.choice(words) for _ in range(n)]
    items, texts = [(k, say(size)) for k in range(4)], []
    for d in range(16):
        item = list(items[d % 4][1])
        for n in range(size // 5):
            at = luck.randrange(len(item))
            item[at : at + (n % 3 > 0)] = say(n % 3 < 2)  # an insertion, a substitution, a deletion
        texts.append(say(d and luck.randrange(40)) + item + say(luck.randrange(40)))
    got = decontam.Items([(k, " ".join(w)) for k, w in items]).search([" ".join(t) for t in texts])
    for d, t in enumerate(texts):
        assert {x["item_id"]: x["edits"] for x in got[d]} == {d % 4: brute_edit(items[d % 4][1], t)}


def edited(luck, say, item, kind):
    """The item at exactly its radius by one kind of edit."""
    item, edits = list(item), len(item) // 5
    for at in sorted(luck.sample(range(len(item)), edits), reverse=True):
        item[at : at + (kind != "insertion")] = say(kind != "deletion")
    return item


@pytest.mark.parametrize("kind", ["substitution", "deletion", "insertion"])
@pytest.mark.parametrize("size", [1, 2, 4, 5, 7, 8, 10, 12, 20, 50, 100, 200])
def test_recall_of_each_kind_of_edit_at_the_radius(size, kind):
    luck = random.Random(size)
    words = ["".join(luck.choice("abcdefghijk") for _ in range(luck.randrange(3, 8))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    say = lambda n: [luck.choice(common) if luck.random() < 0.3 else luck.choice(words) for _ in range(n)]
    items = [(k, say(size)) for k in range(100)]
    texts = [say(luck.randrange(30)) + edited(luck, say, w, kind) + say(luck.randrange(30)) for _, w in items]
    got = decontam.Items([(k, " ".join(w)) for k, w in items]).search([" ".join(t) for t in texts])
    found = [{x["item_id"]: x["edits"] for x in g} for g in got]
    assert all(brute_edit(items[k][1], t) == e <= size // 5 for t, f in zip(texts, found) for k, e in f.items())
    assert sum(d in f for d, f in enumerate(found)) >= (100 if size < decontam.WALK_WORDS else 95)


def test_an_item_of_no_word_is_no_leak():
    got = decontam.Items([(1, " .. "), (2, "kept words")]).search(["some kept words", "", "kept", "words kept"])
    assert [[x["item_id"] for x in g] for g in got] == [[2], [], [], []]
