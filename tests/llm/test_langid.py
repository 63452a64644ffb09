from __future__ import annotations

import math
import time

import numpy as np
import public_tokenizers as P
import pytest

from vesselspark.llm import langid
from vesselspark.llm.langid import START, UNKNOWN, LanguageModel, Scorer, Vocabulary, identify, log_sums, public_pieces, train
from vesselspark.llm.queries import op5_language

PIECES = [START, "a", "b", "ab", START + "a", "aba", "ba", START + "ab", "ü", ".", "!.", "b.", "aa.", "ab!"]


def model():
    rng = np.random.default_rng(1)
    weights = rng.random((len(PIECES) + 1, 2))
    weights[-1] = 0
    return LanguageModel(["xx", "yy"], PIECES, weights / weights.sum(axis=0))


def plain(word, weights):
    """The sum over all segmentations, by recursion."""
    if not word:
        return np.ones(weights.shape[1])
    total = np.zeros(weights.shape[1])
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES:
            total += weights[PIECES.index(word[:n])] * plain(word[n:], weights)
        elif n == 1:
            total += UNKNOWN * plain(word[1:], weights)
    return total


def steps(word, weights, pieces):
    """The logarithm of the same sum for any length, by logarithms at every position."""
    logs = [np.zeros(weights.shape[1])]
    longest = max(map(len, pieces))
    with np.errstate(divide="ignore"):
        for t in range(1, len(word) + 1):
            terms = [logs[t - n] + np.log(weights[pieces[word[t - n : t]]]) for n in range(1, min(t, longest) + 1) if word[t - n : t] in pieces]
            if word[t - 1] not in pieces:
                terms.append(logs[t - 1] + np.log(UNKNOWN))
            logs.append(np.logaddexp.reduce(terms))
    return logs[-1]


@pytest.mark.parametrize("word", ["a", "ab", "abab", "zzab", "abaab.", "ü!", "...", "!.!.", "aa.", "zb!", "b.!", "ab!."])
def test_all_segmentations(word):
    m = model()
    expected = np.log(plain(START + word, m.weights))
    assert np.allclose(Scorer(m).logs([word])[0], expected)
    assert np.allclose(steps(START + word, m.weights, {p: k for k, p in enumerate(PIECES)}), expected)
    assert np.allclose(log_sums(Vocabulary(PIECES), m.weights, [START, START + word])[1], expected)


def test_words_of_any_length():
    """Whole words, summed in blocks and in batches of any size, against sums position by position."""
    rng = np.random.default_rng(5)
    m, at = model(), {p: k for k, p in enumerate(PIECES)}
    words = ["".join(rng.choice(list("abüz.!"), n)) for n in (1, 2, 47, 48, 49, 50, 64, 65, 96, 97, 200, 5000)]
    words += ["a" * 3000, "ab" * 1000, "z" * 2000, "ü!" * 40]
    expected = np.array([steps(START + w, m.weights, at) for w in words])
    assert np.allclose(log_sums(Vocabulary(PIECES), m.weights, [START + w for w in words]), expected, rtol=1e-9)
    many = [w for w in words if len(w) <= 200] * 40
    assert np.allclose(Scorer(m).logs(many), np.tile([e for w, e in zip(words, expected) if len(w) <= 200], (40, 1)), rtol=1e-9)
    text = " ".join(words)
    assert np.allclose(Scorer(m).logs([text, "a"])[0], expected.sum(axis=0), rtol=1e-9)


def test_public_vocabulary_and_long_words():
    pieces = public_pieces(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(7)
    weights = rng.dirichlet(np.full(len(pieces), 0.1), 2).T + 1e-9
    weights = np.r_[weights / weights.sum(axis=0), np.zeros((1, 2))]
    m, at = LanguageModel(["xx", "yy"], pieces, weights), {p: k for k, p in enumerate(pieces)}
    words = ["don't.", "etc...", "it's,", "end.\"", "x" * 100, "theoretically" * 400, "日本語のテキスト。" * 30, "a.b.c.", "(see)", "...", "it.'"]
    assert np.allclose(Scorer(m).logs(words), [steps(START + w, weights, at) for w in words], rtol=1e-9)
    began = time.time()
    Scorer(m).logs(["q7Z+" * 250_000])
    assert time.time() - began < 60


def segmentations(word):
    """All of them, as lists of pieces; None stands for a character that is none."""
    if not word:
        return [[]]
    found = []
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES or n == 1:
            found += [[word[:n] if word[:n] in PIECES else None, *rest] for rest in segmentations(word[n:])]
    return found


def counted(words, counts, known):
    """Expected counts by listing every segmentation."""
    expected = np.zeros(len(PIECES) + 1)
    for word, count in zip(words, counts):
        every = segmentations(word)
        weights = np.array([math.prod(UNKNOWN if p is None else known[PIECES.index(p)] for p in own) for own in every])
        for own, share in zip(every, weights / weights.sum()):
            for p in own:
                if p is not None:
                    expected[PIECES.index(p)] += count * share
    return expected


@pytest.mark.parametrize("long", [48, 0])
def test_learning_against_all_segmentations(long, monkeypatch):
    """Words as a whole, together or one at a time in small slabs, over two rounds."""
    monkeypatch.setattr(langid, "LONG", long)
    monkeypatch.setattr(langid, "SLAB", 3)
    words = [START + w for w in ("a", "ab", "abab", "zzab", "abaab.", "ü!", "!.!.", "aa.", "ababababa", "z")]
    counts = np.arange(1.0, len(words) + 1)
    known = np.full(len(PIECES) + 1, 1 / len(PIECES))
    for _ in range(2):
        expected = counted(words, counts, known) + 0.1
        expected[-1] = 0
        known = expected / expected.sum()
    assert np.allclose(langid._learn(Vocabulary(PIECES), words, counts, 2), known, rtol=1e-9)


def test_learning_from_words_of_any_length():
    """A word of 60,000 characters, cut nowhere: its expectations grow with it, and cover it wholly."""
    vocabulary, known = Vocabulary(PIECES), model().weights[:, 0]
    one, two, three = (langid._expected_of_long(vocabulary, known, "ab" * n) for n in (100, 200, 30_000))
    lengths = np.array([len(p) for p in PIECES] + [0])
    assert (one @ lengths, two @ lengths, three @ lengths) == pytest.approx((200, 400, 60_000))
    assert np.allclose(three, two + (two - one) * 298, rtol=1e-6)
    began = time.time()
    langid._expected_of_long(Vocabulary(public_pieces(P.path("piece_bpe_32k.model"))), np.full(40_000, 1e-5), "abcü日本" * 20_000)
    assert time.time() - began < 20


def test_ties_go_to_the_first_name():
    equal = LanguageModel(["aa", "bb", "cc"], PIECES, np.tile(model().weights[:, :1], 3))
    assert Scorer(equal).predict(["ab", "zz"])[0] == ["aa", "aa"]


def test_texts_add_up():
    scorer = Scorer(model())
    logs = scorer.logs(["ab a", "ab", "a", "b" * 100, ""])
    assert np.allclose(logs[0], logs[1] + logs[2]) and np.isfinite(logs).all()
    assert scorer.predict([None, "", "12 .", "ab"])[0][:3] == ["und"] * 3


def test_edges(spark):
    path = P.path("piece_bpe_32k.model")
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en", 1.0), (2, "der Hund und die Katze", "de", 2.0), (None, "the dog", "en", 3.0),
         (4, None, None, 4.0), (5, "12 34", "de", 5.0), (6, "und der " * 200_000, None, 6.0), (6, "the", "en", 7.0)],
        "doc_id long, text string, lang string, score double",
    )
    got = [(r.id, r.lang_pred, r.score) for r in identify(docs, train(docs, path)).collect()]
    by = {i: x for i, x, _ in got if i != 6}
    assert len(got) == 7 and by == {1: "en", 2: "de", None: "en", 4: "und", 5: "und"}
    assert sorted(x for i, x, _ in got if i == 6) == ["de", "en"] and all(0 <= s <= 1 for *_, s in got)
    nothing = train(docs.limit(0), path)
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), nothing).collect() == []


def test_held_out(spark):
    rows = op5_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = rows.merge(docs, on="doc_id")
    assert len(both) == len(rows) == len(docs) and rows.score.map(math.isfinite).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() >= 0.98


def test_rare_languages_are_learned(spark):
    rows = [(k, f"the cat and the dog number w{k}", "en") for k in range(3000)] + [(9000 + k, "kissa ja koira", "fi") for k in range(3)]
    rows += [(9010, "tämä " * 3_000_000, "xx"), (9011, "tätä", "xx"), *[(9020, "hund og kat", "da")] * 500]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, P.path("piece_bpe_32k.model"), max_docs=50, max_chars=10_000)
    assert model.langs == ["da", "en", "fi", "xx"] and np.allclose(model.weights.sum(axis=0), 1)
    assert Scorer(model).predict(["kissa ja koira", "the dog", "hund og kat", "tämä"])[0] == ["fi", "en", "da", "xx"]
