from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from vesselspark.llm.packing import cut, encoder, fullest, pack, plan

PATHS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_ids_are_the_tokenizers():
    rnd = random.Random(1)
    parts = ["a", "thing", " ", "  ", "\n", "\n\n", " ", "é", "1", "'s", "!", "...", "<|endoftext|>", "\t", "中文", "."]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(1500)] + ["Word, word.\nWord: x"]
    plain, ours = Tokenizer.from_file(PATHS[0]), encoder(*PATHS)
    for text in texts + texts:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_fullest_is_the_best_combination():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 20): rnd.randint(1, 3) for _ in range(5)}
        items = [k for k, n in counts.items() for _ in range(n)]
        longest = max(items)
        items.remove(longest)
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := longest + sum(c)) <= 20)
        used = fullest(counts, 20)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items()) and used[longest]


def test_plan_and_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    places = plan({3: 4, 1: 3, 4: 2}, 4)
    assert max(b + n for p in places.values() for _, b, _, n in p) == 6
    assert plan({}, 4) == {}


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(PATHS[0])
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert docs.keys() == texts.keys()
    for doc, pieces in docs.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(pieces) == 1)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_pack(spark):
    rnd = random.Random(5)
    texts = {k: " ".join(rnd.choices(["one", "two", "three.", "für"], k=rnd.choice([0, 1, 5, 40, 300]))) for k in range(300)}
    texts |= {300: None, 301: "", 302: "x y " * 20_000}
    docs = spark.createDataFrame([(k, v, k) for k, v in texts.items()], "doc_id long, text string, length long")
    n, total = check(pack(docs.repartition(3), *PATHS, capacity=64).collect(), texts, 64)
    assert n <= total / 64 * 1.05 + 1
    assert pack(docs.limit(0), *PATHS).collect() == []
    odd = spark.createDataFrame([(None, "a"), (7, "a"), (7, "a")], "doc_id long, text string")
    assert len(pack(odd, *PATHS).collect()) == 3
