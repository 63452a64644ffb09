from __future__ import annotations

import random

import numpy as np
import public_tokenizers as P

from vesselspark.llm.pieces import MARK, PENALTY, PieceCodec, codec, decode, encode, round_trip

PATH = P.path("piece_bpe_32k.model")
PIECES = ["", MARK, "a", "b", "ab", "aba", MARK + "a", "bab", MARK + MARK, "é"]


def small(seed):
    rnd = random.Random(seed)
    return PieceCodec(PIECES + [""] * 256, [-float(rnd.randint(1, 9)) for _ in PIECES] + [0.0] * 256, list(range(len(PIECES), len(PIECES) + 256)))


def plain(text, own):
    """The best score and path by trying every piece at every end of the whole marked text, longer ones first."""
    text = MARK + text.replace(MARK, "\0").replace(" ", MARK)
    low = min(own.scores[1 : len(PIECES)]) - PENALTY
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for at in range(end):
            if text[at:end] in PIECES:
                k = PIECES.index(text[at:end])
                options.append((best[at][0] + own.scores[k], at - end, [*best[at][1], k]))
        spelt = [*best[end - 1][1], *(own.byte_ids[b] for b in text[end - 1].replace("\0", "▁").encode())]
        options.append((best[end - 1][0] + low, 0, spelt))
        value, _, path = max(options, key=lambda o: (o[0], -o[1]))
        best.append((value, path))
    return best[-1]


def test_best_segmentation():
    rnd = random.Random(1)
    for seed in range(20):
        own = small(seed)
        for _ in range(60):
            text = "".join(rnd.choices("ab é中▁", k=rnd.randint(0, 12)))
            score, path = plain(text, own)
            ids, got = own.encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == path and abs(got - score) < 1e-9 and own.decode(ids) == text


def test_round_trip_of_the_public_model():
    own, rnd = codec(PATH), random.Random(2)
    for text in ["", " ", "  a  b ", "Hello world", "né\n\t中文 🙂", "x" * 5000, "a▁b", "▁", "▁ ▁▁", " ▁x▁", "".join(chr(rnd.randint(1, 0xD7FF)) for _ in range(3000))]:
        assert own.decode(own.encode(text)[0]) == text


def test_frames(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 2), (None, "", 3), (3, "über " * 50_000, 4), (3, "z▁y", 5)], "doc_id long, text string, ids long")
    encoded = encode(docs, PATH)
    assert sorted((r.id or 0, len(r.text), r.n_ids > 0) for r in decode(encoded, PATH).collect()) == [
        (0, 0, True), (1, 3, True), (2, 0, True), (3, 3, True), (3, 250_000, True)]
    trip = round_trip(docs, PATH).collect()
    assert all(r.exact for r in trip) and len(trip) == 5
    assert {(r.id, r.ids_crc32) for r in trip} == {(r.id, r.ids_crc32) for r in decode(encoded, PATH).collect()}
    assert round_trip(docs.limit(0), PATH).collect() == [] and encode(docs.limit(0), PATH).collect() == []
