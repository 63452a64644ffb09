from __future__ import annotations

import random
from hashlib import sha256

import pytest

from vesselspark.llm.fim import LEAST, MOST, Parts, Summaries, chunk_ends, fill_in_middle, restored
from pyspark.sql import functions as F


def plain(doc_id, text):
    """The rule, letter by letter, on Python's code points."""
    text = text or ""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def corpus():
    rnd = random.Random(5)
    letters = "abc é漢😀 \n<>PSM"
    text = lambda n: "".join(rnd.choices(letters, k=n))
    shared = text(9000)
    rows = [text(rnd.randint(0, 40)) for _ in range(300)] + [text(rnd.randint(200, 3000)) for _ in range(40)]
    rows += [text(rnd.randint(1, 700)).replace("<", "") + shared.replace("<", "") for _ in range(20)]
    rows += ["é" * 5000, "x" * 20_000, "😀" * 9000 + "<", "<P", "<P>", "<<P>", "a<S>b", "x" * 5000 + "<M>", "<p>", "\0", "<P<S<M"]
    rows += ["y" * k + "<S>" + "z" * 9000 for k in (LEAST - 2, LEAST - 1, LEAST, MOST - 2, MOST - 1, MOST)]
    return [None, "", *rows, "word é " * 300_000]


def test_chunks_follow_content():
    rnd = random.Random(1)
    data = "".join(rnd.choices("abcdé漢 ", k=60_000)).encode()
    ends = chunk_ends(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and len(sizes) > 20 and all(LEAST <= s <= MOST + 3 for s in sizes[:-1])
    assert all(data[e] & 0xC0 != 0x80 for e in ends[:-1])
    moved = b"something else before it " * 31 + data
    chunks = lambda d: {d[a:b] for a, b in zip([0, *chunk_ends(d)], chunk_ends(d))}
    assert len(chunks(data) & chunks(moved)) >= len(sizes) - 3
    summaries = Summaries()
    Parts(data, summaries)
    assert summaries.met == 0
    Parts(moved, summaries)
    assert summaries.met >= len(sizes) - 3


@pytest.mark.parametrize("limit", [1 << 20, 3000, 0])
def test_parts_put_together(limit):
    summaries = Summaries(limit)
    rnd = random.Random(2)
    for text in corpus()[1:-1]:
        parts = Parts(text.encode(), summaries)
        assert parts.n == len(text) and parts.marked == any(s in text for s in ("<P>", "<S>", "<M>"))
        for place in {0, len(text), *(rnd.randint(0, len(text)) for _ in range(5))}:
            assert parts.byte_of(place) == len(text[:place].encode())
    assert sum(map(len, summaries.young)) <= max(limit, MOST + 3)


def test_matches_the_rule_and_comes_back(spark):
    texts = corpus()
    rows = [(k, t, f"s{k}") for k, t in enumerate(texts)] + [(None, "no id", "x"), (3, texts[3], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string").repartition(3)
    made = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(rows)
    seen = set()
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
        seen.add(r.form)
    assert seen == {"plain", "psm", "spm"}
    assert sorted(r["_text"] for r in made) == sorted(r[2] for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert fill_in_middle(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle(docs.withColumn("Form", F.lit(1)))
    other = fill_in_middle(docs.selectExpr("doc_id", "text", "1 as form"), names=("a", "b", "c", "d", "e"), fim_percent=100, spm_percent=100).first()
    assert other.form == 1 and other.b == "spm"
