"""Language identification by a linear-chain conditional random field over words.

A word's score for a language is a sum of learned weights: of its byte n-grams between boundary marks, of its prefixes
and suffixes, and of itself where it is in the lexicon. Transitions between the languages of neighbouring words are
learned as well. Forward-backward gives each word's posterior, so that code-switched text is labelled word by word; a
text's language has the highest mean posterior. The field is trained on spans of labelled rows; a training sequence joins
spans of several rows, which shows it switches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

WORD = re.compile(r"[^\W\d_]+")
#: Hashed weights: n-grams of 1 to NGRAM bytes, prefixes and suffixes of 1 to AFFIX bytes.
BUCKETS, NGRAM, AFFIX = 1 << 16, 4, 4
#: Words kept with their scores in a worker, words that forward-backward takes at once (a longer text by itself), and words scored at once.
KEPT_WORDS, BATCH_WORDS, SCORED_WORDS = 300_000, 400_000, 20_000
UNKNOWN = "und"
#: The label of words in no language, which sorts behind all others. A field that knows it is trained on words made up for it.
OTHER = "\U0010fffd"
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
RUNS = T.StructField("runs", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType())])))


def words_of(text: str | None) -> list[str]:
    """The lower-case words of a text: runs of letters (a run of other numerals alone is none)."""
    return [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(weights' places, first place of each word): n-gram, affix and lexicon features, all words at once."""
    parts = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(parts)), size)
    left, right = np.arange(len(data)) - (ends - size)[word], ends[word] - np.arange(len(data))
    places, owners = [], []

    def add(gram: np.ndarray, n: int, salt: int, at: np.ndarray) -> None:
        hashed = (gram[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((n * 16 + salt) * 0xC2B2AE3D27D4EB4F % (1 << 64))) >> np.uint64(64 - 16)
        places.append(hashed.astype(np.int64))
        owners.append(word[at])

    gram = np.zeros(len(data), np.uint64)
    for n in range(1, max(NGRAM, AFFIX + 1) + 1):
        gram = gram * np.uint64(257) + np.append(data[n - 1 :], np.zeros(min(n - 1, len(data)), np.uint64))[: len(data)]
        whole = right >= n
        if n <= NGRAM:
            add(gram, n, 1, np.flatnonzero(whole))
        if 2 <= n <= AFFIX + 1:  # with its boundary mark
            add(gram, n, 2, np.flatnonzero(whole & (left == 0)))
            add(gram, n, 3, np.flatnonzero(right == n))
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    places.append(BUCKETS + known[known >= 0])
    owners.append(np.flatnonzero(known >= 0))
    owner, place = np.concatenate(owners), np.concatenate(places)
    order = np.argsort(owner, kind="stable")
    return place[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    """A trained field: languages in alphabetical order, weights by feature and language, transitions, first scores."""

    langs: list[str]
    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    moves: np.ndarray | None = None
    first: np.ndarray | None = None

    def name(self, label: int) -> str:
        return UNKNOWN if self.langs[label] == OTHER else self.langs[label]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Each word's scores, so many words at once that their features stay small."""
        out = [np.zeros((0, len(self.langs)), np.float32)]
        for at in range(0, len(words), SCORED_WORDS):
            place, start = features(words[at : at + SCORED_WORDS], self.lexicon)
            out.append(np.add.reduceat(self.weights[place], start, 0))
        return np.concatenate(out)


def posteriors(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences laid end to end: each word's posterior, and the expected count of each move.

    All sequences advance together, a word a step, longest first, so that a step is one matrix product.
    """
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    start = np.cumsum(sizes) - sizes
    seq = np.repeat(np.arange(len(sizes)), sizes)
    time = np.arange(len(seq)) - start[seq]
    active = np.bincount(time)  # of each step; never grows
    offset = np.cumsum(active) - active
    place = offset[time] + rank[seq]
    x = np.empty(scores.shape)
    x[place] = np.exp(scores - scores.max(1, keepdims=True))
    t, alpha, beta = np.exp(moves - moves.max()), np.empty(x.shape), np.ones(x.shape)
    bounds = list(zip(offset.tolist(), active.tolist()))
    for s, (o, a) in enumerate(bounds):
        now = x[o : o + a] * (np.exp(first - first.max()) if s == 0 else alpha[bounds[s - 1][0] : bounds[s - 1][0] + a] @ t)
        alpha[o : o + a] = now / now.sum(1, keepdims=True)
    expected = np.zeros(t.shape)
    for s in range(len(bounds) - 2, -1, -1):
        o, (p, a) = bounds[s][0], bounds[s + 1]
        after = x[p : p + a] * beta[p : p + a]
        now = after @ t.T
        scale = now.sum(1, keepdims=True)
        beta[o : o + a] = now / scale
        joint = alpha[o : o + a]
        expected += ((joint / (joint * now).sum(1, keepdims=True)).T @ after) * t
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    return gamma[place], expected


def fit(spans: list[tuple[str, list[str]]], rounds: int = 30, rate: float = 0.4, penalty: float = 1e-4, lexicon_count: int = 2, joined: int = 4) -> Model:
    """Train on (language, words) spans by full-batch adaptive gradient ascent of the conditional likelihood.

    Sequences join ``joined`` spans in the order given. The lexicon holds words seen ``lexicon_count`` times. No spans: a
    model that knows no language.
    """
    spans = [s for s in spans if s[1]]
    langs = sorted({s[0] for s in spans})
    model = Model(langs)
    if not langs:
        return model
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for _, ws in spans for w in ws])
    gold = np.repeat([langs.index(s[0]) for s in spans], [len(s[1]) for s in spans])
    sizes = np.array([sum(len(s[1]) for s in spans[k : k + joined]) for k in range(0, len(spans), joined)])
    counts, vocabulary = np.bincount(flat), list(ids)
    model.lexicon = {w: n for n, w in enumerate(w for w, c in zip(vocabulary, counts) if c >= lexicon_count)}
    place, start = features(vocabulary, model.lexicon)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(start, len(place))))
    n, m = BUCKETS + len(model.lexicon), len(langs)
    w, moves, first = np.zeros((n, m)), np.zeros((m, m)), np.zeros(m)
    sums = [np.full(a.shape, 1e-8) for a in (w, moves, first)]
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(flat), bool)
    inner[starts] = False
    right = np.flatnonzero(inner)
    truth = np.zeros((m, m))
    np.add.at(truth, (gold[right - 1], gold[right]), 1)
    for _ in range(rounds):
        emitted = np.add.reduceat(w[place], start, 0)
        gamma, expected = posteriors(emitted[flat], sizes, moves, first)
        error = -gamma
        error[np.arange(len(flat)), gold] += 1
        by_word = np.stack([np.bincount(flat, error[:, c], len(vocabulary)) for c in range(m)], 1)
        slopes = [np.stack([np.bincount(place, by_word[owner, c], n) for c in range(m)], 1) / len(flat) - penalty * w, (truth - expected) / len(flat), error[starts].sum(0) / len(flat)]
        for value, slope, total in zip((w, moves, first), slopes, sums):
            total += slope**2
            value += rate * slope / np.sqrt(total)
    model.weights, model.moves, model.first = w.astype(np.float32), moves, first
    return model


def training_spans(df: DataFrame, per_lang: int = 800, spans: int = 2, span_words: int = 30) -> list[tuple[str, list[str]]]:
    """A bounded sample of labelled rows (text, lang, pick): about ``per_lang`` rows of each language, ``spans`` runs of words each.

    ``pick`` is a hash that orders rows at random. Runs start anywhere in a text. At most twice ``per_lang`` rows a
    language are taken.
    """
    labelled = df.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))])
    taken = labelled.where((F.col("pick") / F.lit(float(2**32))) < share[F.col("lang")]).limit(2 * per_lang * len(counts))

    def run(batches):
        for batch in batches:
            langs, found = [], []
            for lang, text, pick in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("lang", "text", "pick")]):
                words, luck = words_of(text.as_py()), np.random.default_rng(pick.as_py())
                for _ in range(spans if words else 0):
                    at = int(luck.integers(max(1, len(words) - span_words + 1)))
                    langs.append(lang.as_py())
                    found.append(words[at : at + int(luck.integers(span_words // 3, span_words + 1))])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["lang", "words"])

    got = taken.select("lang", "text", "pick").mapInArrow(run, "lang string, words array<string>").collect()
    rows = sorted((r["lang"], r["words"]) for r in got)  # the same model however rows arrive
    return [rows[k] for k in np.random.default_rng(1).permutation(len(rows))]


#: First letters and sizes of blocks of letters that made-up words take theirs from: Latin, Greek, Cyrillic, Hebrew, Arabic,
#: Devanagari, Thai, Georgian, kana, ideographs, Hangul.
BLOCKS = ((0x61, 26), (0xDF, 24), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x627, 26), (0x905, 53), (0xE01, 46), (0x10D0, 33), (0x3041, 86), (0x30A1, 90), (0x4E00, 20_000), (0xAC00, 11_000))


def made_up(spans: list[tuple[str, list[str]]], seed: int = 3) -> list[tuple[str, list[str]]]:
    """Spans of words in no language, about as many as the languages have on average: of each span, either its words with
    their letters in random order or words as long in random letters of one of the BLOCKS."""
    luck, out = np.random.default_rng(seed), []
    langs = len({lang for lang, _ in spans})
    for k in range(0, len(spans), max(1, langs)):
        words = spans[k][1]
        if luck.random() < 0.4:
            out.append((OTHER, ["".join(luck.permutation(list(w))) for w in words]))
        else:
            at, size = BLOCKS[int(luck.integers(len(BLOCKS)))]
            out.append((OTHER, ["".join(chr(at + int(c)) for c in luck.integers(0, size, max(1, len(w)))) for w in words]))
    return out


class _Words(dict):
    """Numbers words as they come; new ones wait for their scores. A word without a letter is -1."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []
        self.n = 0

    def __missing__(self, word: str) -> int:
        if not (word.isalpha() or any(c.isalpha() for c in word)):
            self[word] = -1
            return -1
        self[word] = self.n
        self.n += 1
        self.waiting.append(word)
        return self.n - 1


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, runs: bool = False) -> DataFrame:
    """The ``keep`` columns (all), ``lang_pred`` and ``score``, its mean posterior over the text's words.

    With ``runs`` also the words' own labels: an array of (lang, first, words), the runs of neighbouring words whose best
    label is the same, so that code-switched text comes apart. Whole texts of any length; ties go to the first language in
    alphabetical order. Null texts and those without a letter, and all texts under a model that knows no language, are
    ``und`` with score 0 and no runs; words in no language, where the model knows such, are ``und`` with their score. Rows
    pass one by one, repeated rows too.
    """

    def work():
        state = {"words": _Words(), "scores": np.zeros((0, len(model.langs)), np.float32)}

        def label(rows: list[np.ndarray]) -> list[tuple[str, float, list[dict]]]:
            words = state["words"]
            if words.waiting:
                state["scores"] = np.concatenate([state["scores"], model.emissions(words.waiting)])
                words.waiting = []
            sizes = np.array([len(r) for r in rows])
            real = np.flatnonzero(sizes)
            out = [(UNKNOWN, 0.0, [])] * len(rows)
            if len(real):
                gamma, _ = posteriors(state["scores"][np.concatenate([rows[k] for k in real])], sizes[real], model.moves, model.first)
                starts = np.cumsum(sizes[real]) - sizes[real]
                mean = np.add.reduceat(gamma, starts, 0) / sizes[real][:, None]
                for k, best, p, start in zip(real, mean.argmax(1), mean.max(1), starts):
                    out[k] = (model.name(best), min(1.0, float(p)), _runs(model, gamma[start : start + sizes[k]].argmax(1)) if runs else [])
            if len(words) > KEPT_WORDS:
                state["words"], state["scores"] = _Words(), state["scores"][:0]
            return out

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            found, rows, size = [], [], 0
            for value in batch.column(batch.schema.get_field_index(text)):
                got = WORD.findall((value.as_py() or "").lower()) if model.langs else []
                ids = np.fromiter(map(state["words"].__getitem__, got), np.int32, len(got))
                rows.append(ids[ids >= 0])
                size += len(got)
                if size >= BATCH_WORDS:
                    found += label(rows)
                    rows, size = [], 0
            if rows:
                found += label(rows)
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *([pa.array([f[2] for f in found], kind)] if runs else [])]

        return each

    return add_columns(df, FIELDS + [RUNS] * runs, work, [text], df.columns if keep is None else keep)


def _runs(model: Model, labels: np.ndarray) -> list[dict]:
    starts = np.append(0, np.flatnonzero(np.diff(labels)) + 1)
    return [{"lang": model.name(labels[a]), "first": a, "words": n} for a, n in zip(starts.tolist(), np.diff(np.append(starts, len(labels))).tolist())]


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(df: DataFrame, per_lang: int = 800, other: bool = False) -> Model:
    """A model from the rows of ``df`` (doc_id, text, lang) that aren't held out; with ``other`` it knows words in no language."""
    pick = F.expr("crc32(CAST(concat('pick ', coalesce(CAST(doc_id AS STRING), '')) AS BINARY))")
    spans = training_spans(df.where(~held_out()).select("text", F.col("lang"), pick.alias("pick")), per_lang)
    if not other or not spans:
        return fit(spans)
    every = spans + made_up(spans)
    return fit([every[k] for k in np.random.default_rng(2).permutation(len(every))])
