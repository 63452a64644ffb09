from __future__ import annotations

import random
import re

import pytest

from vesselspark.llm.decontaminate import Automaton, decontaminate, find_items, joined, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, window):
    """All windows at all places."""
    words, hit, names, windows = split(text), set(), set(), {}
    for name, item in items:
        own = split(item)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(name)
    for size in {len(w) for w in windows}:
        for at in range(len(words) - size + 1):
            found = windows.get(tuple(words[at : at + size]))
            if found:
                hit |= set(range(at, at + size))
                names |= {str(n) for n in found if n is not None}
    return len(words), hit, sorted(names)


def drawn(seed, letters=3):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice("abcdefgh"[:letters]) for _ in range(n))
    items = [(k, text(rnd.randint(0, 14))) for k in range(rnd.randint(0, 8))]
    docs = [text(rnd.randint(0, 60)) for _ in range(10)]
    docs += [f"{text(3)} {rnd.choice(items)[1]} {text(2)}" for _ in range(5) if items]
    return items, docs


@pytest.mark.parametrize("window", [1, 2, 4, 10])
def test_automaton_against_all_windows(window):
    for seed in range(60):
        items, docs = drawn(seed, 2 + seed % 3)
        automaton = Automaton([(str(n), words_of(t.encode())) for n, t in items if split(t)], window)
        for doc in docs:
            stretches, names = automaton.hits(words_of(doc.encode()))
            _, hit, want = plain(doc, items, window)
            assert {k for low, high in stretches for k in range(low, high)} == hit and sorted(names) == want
            assert stretches == joined(stretches)


def tables():
    rnd = random.Random(9)
    vocab = [f"w{k}é" for k in range(60)] + ["über", "x1", "漢字"]
    text = lambda n: " ".join(rnd.choices(vocab, k=n))
    items = [(k, text(rnd.randint(1, 40))) for k in range(40)] + [(100, "Short ITEM"), (101, "short item"), (None, text(12)), (103, None), (104, " ,.- "), (105, text(9)), (106, text(10))]
    items += [(107, items[3][1]), (3, items[4][1]), (12, items[5][1] + " tail"), (108, text(9000))]
    docs = [text(rnd.randint(0, 80)) for _ in range(40)]
    for _, item in items[:46]:
        docs.append(f"{text(4)}\n{(item or '').upper()}! {text(5)}")
    docs += ["Short-item,short   item", "SHORT; itemé", items[-1][1][100:9000], None, "", "!!", text(20_000) + " short item " + items[7][1], docs[50], docs[50]]
    return items, docs


@pytest.mark.parametrize("shard_bytes", [1_000_000, 9000])
def test_matches_all_windows(spark, shard_bytes):
    items, docs = tables()
    df = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(docs)] + [(None, docs[45], "n")], "doc_id long, text string, id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = find_items(df, bench, shard_bytes=shard_bytes).collect()
    assert len(rows) == len(docs) + 1
    for r in rows:
        n, hit, names = plain(r.text, items, 10)
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), names), r.doc_id
        inside = [w for s in r.spans for w in split(r.text[s.start : s.end])]
        assert inside == [w for k, w in enumerate(split(r.text)) if k in hit]
        assert r.id == ("n" if r.doc_id is None else f"s{r.doc_id}")


def test_removes_spans_and_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    long = " ".join(f"x{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"É, {long} {item.upper()}. end", 5), (2, f"a {item} b", 5), (3, "clean text", 5), (4, None, 5), (5, f"{item}; {long} {item}", 5)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_words) for r in decontaminate(df, bench).collect()}
    assert got == {1: (f"É, {long} . end", 5), 3: ("clean text", 5), 4: (None, 5), 5: (f"; {long} ", 5)}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b")], "item_id long, text string")
    assert find_items(docs.limit(0), bench).collect() == []
    none = find_items(docs, bench.limit(0)).first()
    assert (none.n_words, none.n_hit, none["items"], none.spans) == (2, 0, [], [])
    with pytest.raises(ValueError):
        find_items(docs.selectExpr("*", "1 as N_HIT"), bench)
