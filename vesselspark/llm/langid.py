"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. The probability of a word, with the mark of a
blank before it, is the sum over all its segmentations into pieces, by a forward algorithm; a text's is the product over
its words. The probabilities are learned by expectation maximisation, one language a task, whose expected piece counts
come from the same algorithm run both ways. The algorithm runs in numpy over many words at once. In scoring, a word is
computed once per worker and remembered, in two parts where no piece crosses from one to the other.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.llm.common import map_texts

START = "▁"
SLOT_BITS = 18
MAYBE_BITS = 22
SCALE = 1e3
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)
UNKNOWN = 1e-7  # of a single character that is no piece
#: The sample of a language: so many documents, and no more of them once they have so many characters.
DOCS_A_LANGUAGE = 1000
CHARS_A_LANGUAGE = 4_000_000
CACHED_WORDS = 250_000
REMEMBERED = 64  # longer words are not kept
BLOCK = 32  # positions between which sums are scaled anew; the least weight, of 1e-9, leaves them within range
CELLS = 1 << 17  # code points of words that are summed at once, and so many words
WORDS = 1 << 12
LOOKED_UP = 1 << 13
FEW = 64
LONG = 48  # expectations of longer words are taken a word at a time, in slabs of SLAB characters and scaled every BLOCK
SLAB = 1 << 13


class Vocabulary:
    """The pieces as an open hash table that numpy can look many strings up in at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        self.size = len(pieces)
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.hashes = np.r_[hashes, np.uint64(0)]
        self.slots = np.full((4, 1 << SLOT_BITS), self.size, dtype=np.int32)
        for k, slot in enumerate(self._slot(hashes)):
            row = next(r for r in range(4) if self.slots[r, slot] == self.size)
            self.slots[row, slot] = k
        self.depth = int((self.slots != self.size).any(axis=1).sum())
        self.maybe = np.zeros(1 << MAYBE_BITS, dtype=bool)  # most strings are no piece: one look tells
        self.maybe[(hashes * MIX) >> np.uint64(64 - MAYBE_BITS)] = True
        self.split = splitter(pieces)

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(STEP) + ord(c) + 1) & (1 << 64) - 1
        return value

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * MIX) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, ``size`` where there is none."""
        found = np.full(hashes.shape, self.size, dtype=np.int32)
        likely = np.nonzero(self.maybe[(hashes * MIX) >> np.uint64(64 - MAYBE_BITS)])
        wanted = hashes[likely]
        slot, here = self._slot(wanted), np.full(len(wanted), self.size, dtype=np.int32)
        for row in range(self.depth):
            piece = self.slots[row][slot]
            here = np.where((self.hashes[piece] == wanted) & (wanted != 0), piece, here)
        found[likely] = here
        return found


def public_pieces(path: str) -> list[str]:
    """The text pieces of a sentencepiece model, in order; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(k) for k in ids if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]


def splitter(pieces: list[str]) -> Callable[[str], tuple[str, str]]:
    """What parts a marked word from the punctuation at its end, if no segmentation of it has a piece across that border;
    the word's sum is then the product of theirs."""
    across: dict[str, list[tuple[str, str]]] = {}  # by the two characters at the border
    for piece in pieces:
        bare = piece.rstrip(string.punctuation)
        if bare and bare != piece:
            across.setdefault(piece[len(bare) - 1 : len(bare) + 1], []).append((bare, piece[len(bare) :]))

    def split(word: str) -> tuple[str, str]:
        stem = word.rstrip(string.punctuation)
        at = len(stem)
        if at == len(word) or any(stem.endswith(s) and word.startswith(t, at) for s, t in across.get(word[at - 1 : at + 1], ())):
            return word, ""
        return stem, word[at:]

    return split


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    points = np.zeros((len(words), int(lengths.max())), dtype=np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points[np.arange(points.shape[1]) < lengths[:, None]] = flat
    return points, lengths


def _lattice(vocabulary: Vocabulary, points: np.ndarray) -> list[np.ndarray]:
    """For each length n, the piece numbers (words x starts) of the substrings of that length."""
    rolled, found = np.zeros_like(points), []
    for n in range(1, min(vocabulary.longest, points.shape[1]) + 1):
        width = points.shape[1] - n + 1
        rolled = rolled[:, :width] * STEP + points[:, n - 1 :] + np.uint64(1)
        rolled[points[:, n - 1 :] == 0] = 0
        found.append(vocabulary.find(rolled))
    return found


def log_sums(vocabulary: Vocabulary, weights: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, languages): the logarithm of each word's sum over all its segmentations. ``weights``: (pieces + 1,
    languages), the last row zero. Words may have any length: only the sums of as many positions as the longest piece has
    are kept, and every BLOCK positions they are scaled to a largest one of 1."""
    result = np.zeros((len(words), weights.shape[1]))
    by_length = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(words):
        size = max(1, min(WORDS, len(words) - at, CELLS // max(1, len(words[by_length[at]]))))
        while size > 1 and size * len(words[by_length[at + size - 1]]) > CELLS:
            size = -(-size // 2)
        part = by_length[at : at + size]
        result[part] = _sums_of_sorted(vocabulary, weights, [words[k] for k in part])
        at += size
    return result


def _sums_of_sorted(vocabulary: Vocabulary, weights: np.ndarray, words: list[str]) -> np.ndarray:
    points, lengths = _matrix(words)
    width, reach, no_piece = points.shape[1], vocabulary.longest, len(weights) - 1
    result, shift = np.zeros((len(words), weights.shape[1])), np.zeros((len(words), weights.shape[1]))
    scaled = [weights * SCALE**n for n in range(reach + 1)]
    scaled[1][-1] = UNKNOWN * SCALE
    # sums[reach + k]: over the first (begin of the block) + k characters, times SCALE for each
    sums = np.zeros((reach + min(BLOCK, width) + 1, len(words), weights.shape[1]))
    sums[reach] = 1
    known, low, first = 0, 0, 0  # up to where, from where and from which word on pieces are looked up
    for begin in range(0, width, BLOCK):
        alive = int(np.searchsorted(lengths, begin, side="right"))  # shorter words are done
        end = min(width, begin + BLOCK)
        if end > known:
            low, first = max(0, begin - reach + 1), alive
            known = min(width, begin + BLOCK * max(1, LOOKED_UP // (BLOCK * (len(words) - alive))))
            lattice = _lattice(vocabulary, points[first:, low:known])
        own = sums[:, alive:]
        step = _few if len(words) - alive <= FEW else _many
        step([x[alive - first :] for x in lattice], own, scaled, begin - low, end - begin, reach, no_piece)
        ended = np.arange(alive, int(np.searchsorted(lengths, end, side="right")))
        at = lengths[ended]
        result[ended] = np.log(sums[reach + at - begin, ended]) + shift[ended] - np.log(SCALE) * at[:, None]
        if end < width:
            last = own[end - begin : end - begin + reach + 1].copy()
            most = last.max(axis=0)
            own[: reach + 1] = last / most
            shift[alive:] += np.log(most)
    return result


def _many(lattice, sums, scaled, ahead: int, steps: int, reach: int, no_piece: int) -> None:
    """Fill a block's sums, position by position and only where there are pieces. ``ahead``: the lattice's positions
    before the block."""
    for t in range(1, steps + 1):
        now = reach + t
        sums[now] = sums[now - 1] * scaled[1][lattice[0][:, ahead + t - 1]]
        for n in range(2, min(ahead + t, len(lattice)) + 1):
            piece = lattice[n - 1][:, ahead + t - n]
            hit = np.flatnonzero(piece < no_piece)
            if len(hit):
                sums[now, hit] += sums[now - n, hit] * scaled[n][piece[hit]]


def _few(lattice, sums, scaled, ahead: int, steps: int, reach: int, no_piece: int) -> None:
    """The same for few words: the weights of all lengths at once."""
    words, langs = sums.shape[1:]
    shares = np.zeros((steps, reach, words, langs))  # of the pieces that start ``reach - k`` positions before an end
    for n, pieces in enumerate(lattice, 1):
        first = max(1, n - ahead)  # the first end in the block with so long a piece
        shares[first - 1 :, reach - n] = scaled[n][pieces[:, ahead + first - n : ahead + steps - n + 1].T]
    for t in range(1, steps + 1):
        sums[reach + t] = np.einsum("nwl,nwl->wl", sums[t : reach + t], shares[t - 1])


@dataclass
class LanguageModel:
    """``weights[k, l]``: the probability of piece k in language l; a last row of zeros stands for no piece."""

    langs: list[str]
    pieces: list[str]
    weights: np.ndarray


def _word_counts(split: Callable[[str], tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [part for w in (text or "").split() for part in split(START + w) if part]
                langs += [lang] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], ["lang", "word"])

    return run


def _sample(docs: DataFrame, max_docs: int, max_chars: int) -> DataFrame:
    """``(lang, text)``: of each language the first ``max_docs`` ids of ``docs(id, lang, text)`` by their hash, with the
    least text of each, and of these the first until they have ``max_chars`` characters. A language's ids are ranked among
    those whose hash is in the first part of its range, a part that four times as many are expected in, so few are ranked."""
    number = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    counts = docs.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"))
    first = number * F.col("n") < F.lit(float(4 * max_docs * (1 << 40)))
    # a row a language, as in the model itself; a shuffled join would bring all rows of a language together
    few = docs.select("lang", "id").join(F.broadcast(counts), "lang").where(first).select("lang", "id").distinct()
    order = Window.partitionBy("lang").orderBy(number, "id")
    picked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_docs).select("lang", "id")
    found = docs.join(F.broadcast(picked), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text"))  # at most max_docs a language
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_chars).select("lang", "text")


def train(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_docs: int = DOCS_A_LANGUAGE, max_chars: int = CHARS_A_LANGUAGE, rounds: int = 4) -> LanguageModel:
    """Fit each language on at most ``max_docs`` of its documents, the first by a hash of the id, and on no more of these
    once they have ``max_chars`` characters. Rare languages have the same bounds as frequent ones. Rows without an id or a
    language are not used; of rows that share both, the least text is."""
    chosen = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    pieces = public_pieces(pieces_path)
    sample = _sample(chosen, max_docs, max_chars)
    counts = sample.mapInArrow(_word_counts(splitter(pieces)), "lang string, word string").groupBy("lang", "word").count()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("word")
        weights = _learn(Vocabulary(shared.value), own.word.to_list(), own["count"].to_numpy(float), rounds)
        return pd.DataFrame({"lang": own.lang[:1].to_list(), "weights": [weights.tobytes()]})

    rows = sorted(counts.groupBy("lang").applyInPandas(learn, "lang string, weights binary").collect())  # a row a language
    weights = np.zeros((len(pieces) + 1, len(rows)))
    for k, row in enumerate(rows):
        weights[:, k] = np.frombuffer(row.weights)
    return LanguageModel([r.lang for r in rows], pieces, weights)


def _forward(lattice: list[np.ndarray], known: np.ndarray, width: int) -> np.ndarray:
    """Sums over all segmentations of each word's first t characters, times SCALE**t, for words of at most LONG ones."""
    sums = np.zeros((width + 1, lattice[0].shape[0], 1))
    scaled = [known[:, None] * SCALE**n for n in range(len(lattice) + 1)]
    scaled[1][-1] = UNKNOWN * SCALE
    padded = np.concatenate([np.zeros((len(lattice), *sums.shape[1:])), sums])
    padded[len(lattice)] = 1
    _many(lattice, padded, scaled, 0, width, len(lattice), len(known) - 1)
    return padded[len(lattice) :, :, 0]


def _expected(vocabulary: Vocabulary, known: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in all segmentations of words of at most LONG characters, by their probabilities."""
    expected = np.zeros(vocabulary.size + 1)
    by_length = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(words), WORDS):
        part = by_length[at : at + WORDS]
        points, lengths = _matrix([words[k] for k in part])
        lattice, width = _lattice(vocabulary, points), points.shape[1]
        ahead = _forward(lattice, known, width)
        behind = np.zeros((width + 1, len(part)))  # the same sums over the characters from t on
        behind[lengths, np.arange(len(part))] = 1
        single = np.where(lattice[0] < vocabulary.size, known[lattice[0]], UNKNOWN) * SCALE
        for t in range(width - 1, -1, -1):
            behind[t] += behind[t + 1] * np.where(points[:, t] != 0, single[:, t], 0)
            for n in range(2, min(width - t, len(lattice)) + 1):
                behind[t] += behind[t + n] * known[lattice[n - 1][:, t]] * SCALE**n
        weight = counts[part] / behind[0]
        for n, found in enumerate(lattice, 1):
            for t in range(width - n + 1):
                piece = found[:, t]
                share = ahead[t] * known[piece] * SCALE**n * behind[t + n] * weight
                expected += np.bincount(piece, share, len(expected))
    return expected


def _slab(vocabulary: Vocabulary, known: np.ndarray, points: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights (starts x lengths) of the pieces of one word that start from ``low`` to ``high``."""
    reach = vocabulary.longest
    pieces = np.full((high - low, reach), vocabulary.size, dtype=np.int32)
    for n, found in enumerate(_lattice(vocabulary, points[None, low : high + reach - 1]), 1):
        own = found[0, : high - low]
        pieces[: len(own), n - 1] = own
    weights = known[pieces]
    weights[pieces[:, 0] == vocabulary.size, 0] = UNKNOWN
    return pieces, weights


def _log_chain(slabs: Iterator[np.ndarray], size: int, reach: int) -> np.ndarray:
    """Logarithms of sums along a word: each is the weights of a row, nearest last, times the ``reach`` sums before it."""
    logs, at, shift = np.zeros(size + 1), 0, 0.0
    window = np.zeros(reach)
    window[-1] = 1
    for rows in slabs:
        for begin in range(0, len(rows), BLOCK):
            part = rows[begin : begin + BLOCK]
            sums = np.concatenate([window, np.empty(len(part))])
            for t, row in enumerate(part):
                sums[reach + t] = row @ sums[t : reach + t]
            logs[at + 1 : at + 1 + len(part)] = np.log(sums[reach:]) + shift
            at += len(part)
            shift += float(np.log(sums[-1]))
            window = sums[-reach:] / sums[-1]
    return logs


def _expected_of_long(vocabulary: Vocabulary, known: np.ndarray, word: str) -> np.ndarray:
    """The same of one word of any length: its whole segmentations, with two logarithms a character held."""
    points, size, reach = _matrix([word])[0][0], len(word), vocabulary.longest

    def by_end(low: int, high: int) -> np.ndarray:
        """Weights of pieces that end after ``low`` up to ``high``, those of length n in column reach - n."""
        first = max(0, low - reach + 1)
        weights = np.concatenate([np.zeros((first - (low - reach + 1), reach)), _slab(vocabulary, known, points, first, high)[1]])
        columns = [weights[reach - n : reach - n + high - low, n - 1] for n in range(reach, 0, -1)]
        return np.stack(columns, axis=1)

    starts = range(0, size, SLAB)
    ahead = _log_chain((by_end(low, min(size, low + SLAB)) for low in starts), size, reach)
    back = (_slab(vocabulary, known, points, low, min(size, low + SLAB))[1][::-1, ::-1] for low in reversed(starts))
    behind = _log_chain(back, size, reach)[::-1]
    expected, beyond = np.zeros(vocabulary.size + 1), np.r_[behind, np.zeros(reach)]
    for low in starts:
        high = min(size, low + SLAB)
        pieces, weights = _slab(vocabulary, known, points, low, high)
        for n in range(1, reach + 1):
            hit = np.flatnonzero(pieces[:, n - 1] < vocabulary.size)
            share = np.exp(ahead[low + hit] + beyond[low + hit + n] - ahead[size]) * weights[hit, n - 1]
            expected += np.bincount(pieces[hit, n - 1], share, len(expected))
    return expected


def _learn(vocabulary: Vocabulary, words: list[str], counts: np.ndarray, rounds: int) -> np.ndarray:
    """One language's piece probabilities by expectation maximisation over whole words, smoothed by a tenth of a count
    each."""
    known = np.full(vocabulary.size + 1, 1 / vocabulary.size)
    known[-1] = 0
    is_long = np.array([len(w) > LONG for w in words], dtype=bool)
    short, long = [[w for w, own in zip(words, is_long) if own == kind] for kind in (False, True)]
    for _ in range(rounds):
        expected = _expected(vocabulary, known, short, counts[~is_long]) + 0.1
        for word, count in zip(long, counts[is_long]):
            expected += count * _expected_of_long(vocabulary, known, word)
        expected[-1] = 0
        known = expected / expected.sum()
    return known


class Scorer:
    """Log-probabilities of words in all languages, computed in batches and remembered."""

    def __init__(self, model: LanguageModel, cached_words: int = CACHED_WORDS):
        self.model, self.vocabulary, self.cached_words = model, Vocabulary(model.pieces), cached_words
        self._forget()

    def _forget(self) -> None:
        self.known, self.parts = {}, {"": 0}
        self.table, self.used = np.zeros((1 << 12, len(self.model.langs))), 1

    def _add(self, known: dict[str, int], words: list[str], rows: np.ndarray) -> None:
        while self.used + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used : self.used + len(words)] = rows
        known.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)

    def _learn(self, words: list[str]) -> None:
        """Compute new words: their parts first, then the sums of these."""
        stems, tails = zip(*[self.vocabulary.split(START + w) for w in words])
        new = [x for x in dict.fromkeys((*stems, *tails)) if x not in self.parts]
        if new:
            self._add(self.parts, new, log_sums(self.vocabulary, self.model.weights, new))
        rows = [self.table[list(map(self.parts.__getitem__, x))] for x in (stems, tails)]
        self._add(self.known, words, rows[0] + rows[1])

    def logs(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): the log-probability of each whole text."""
        if len(self.known) > self.cached_words:
            self._forget()
        split = [x.split() for x in texts]
        total = np.zeros((len(texts), len(self.model.langs)))
        self._add_long(texts, split, total)
        rows = [list(map(self.known.get, words)) for words in split]
        lacking = [k for k, own in enumerate(rows) if None in own]
        if lacking:
            self._learn(list({w for k in lacking for w, row in zip(split[k], rows[k]) if row is None}))
            for k in lacking:
                rows[k] = list(map(self.known.__getitem__, split[k]))
        return total + np.stack([self.table[own].sum(axis=0) for own in rows])

    def _add_long(self, texts: list[str], split: list[list[str]], total: np.ndarray) -> None:
        """Take the words that are not remembered out of ``split`` and add them to ``total``."""
        long: list[tuple[int, str, int]] = []
        for k, words in enumerate(split):
            if len(texts[k]) > REMEMBERED and max(map(len, words), default=0) > REMEMBERED:
                long += [(k, w, n) for w, n in Counter(w for w in words if len(w) > REMEMBERED).items()]
                split[k] = [w for w in words if len(w) <= REMEMBERED]
        if long:
            logs = log_sums(self.vocabulary, self.model.weights, [START + w for _, w, _ in long])
            np.add.at(total, [k for k, _, _ in long], logs * np.array([n for _, _, n in long])[:, None])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, sure = [], []
        has_letter = [any(map(str.isalpha, x or "")) for x in texts]
        rows = self.logs([x for x, ok in zip(texts, has_letter) if ok]) if any(has_letter) and self.model.langs else ()
        rows = iter(rows)
        for ok in has_letter:
            if not ok or not self.model.langs:
                langs.append("und")
                sure.append(0.0)
                continue
            row = next(rows)
            best = int(np.argmax(row))
            langs.append(self.model.langs[best])
            sure.append(float(1 / np.exp(row - row[best]).sum()))
        return langs, sure


def annotate(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"),
             cached_words: int = CACHED_WORDS) -> DataFrame:
    """``docs`` with the language of every row's whole text and its share of the probability. A worker remembers about
    ``cached_words`` words."""
    fixed = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and the languages
    fields = [(names[0], "string", pa.string()), (names[1], "double", pa.float64())]
    return map_texts(docs, text_col, lambda: Scorer(fixed.value, cached_words).predict, fields)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every row's whole text: the likeliest learned language and its share of the
    probability. Texts that are null or have no letter are ``und`` with score 0, as is all if nothing was learned.
    Ties go to the first language by name; null and repeated ids keep their rows; other columns are not read. Texts and
    words of any length are summed whole; an empty table gives none."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return annotate(base, model).drop("text")
