from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from vesselspark.llm import pii
from vesselspark.llm.pii import KINDS, PiiModel, Trees, base_spans, calibrate, candidates, find, joined, luhn, redacted, spans, train, training_rows

#: The patterns as stated, without regard to speed.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for k, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(d) for d in digits[::-1]]
            check = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(odd)) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 12 <= len(digits) <= 19 and check, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_is_as_stated():
    rnd = random.Random(4)
    for alphabet in ("a.@-_ 1", "0123456789 -", "1.2 25 ", "+(5) .-67890é"):
        for _ in range(3000):
            text = "".join(rnd.choices(alphabet, k=rnd.randint(0, 40)))
            assert base_spans(text) == plain(text), text
    assert joined(base_spans("x 4539148803436467 y a@b.co")) == "card:2:18,email:21:27"
    assert luhn("4539148803436467") and not luhn("4539148803436468")


def test_long_texts_take_linear_time():
    began = time.time()
    for part in ("a", "1", "a.", "1.", "1 ", "+1", "a@", "@", "(", "é@", "1:", " at a dot "):
        base_spans(part * 300_000 + "@1")
        candidates(part * 30_000 + "@1")
    assert time.time() - began < 60


def test_long_logs_with_trees_take_linear_time(spark):
    model = train(spark.createDataFrame(corpus(), "doc_id long, text string"))
    line = "10.1.2.3 - [2024-01-07 10 20 30] 12 345 678 901 jane{0} (at) mail (dot) com 4539.1488.0343.6467\n"
    times = []
    for n in (1000, 20_000):
        text = "".join(line.format(k) for k in range(n))
        began = time.time()
        base, every = spans(text, model)
        times.append(time.time() - began)
        kinds = [k for _, k, _ in every]
        assert len(base) >= n and kinds.count(0) == n and kinds.count(2) == n
        assert all(a[2] <= b[0] for a, b in zip(every, every[1:]))
    assert len(text) > 1_900_000 and times[1] < 40 * max(times[0], 0.05)


def test_candidates_at_every_offset():
    for sep, card in ((" ", "4539.1488.0343.6467"), (" ", "4539 1488 0343 6467"), ("-", "4539-1488-0343-6467")):
        for k in range(25):
            before = "".join(f"{10 + i}{sep}" for i in range(k))
            text = before + card + f"{sep}77" * (k % 7)
            assert (len(before), 2, len(before) + len(card)) in candidates(text), text
    for form in ("jane @ mail.com", "jane@mail(dot)com", "jane at mail.com", "jane (at) mail (dot) com", "jané@mail.com"):
        assert (9, 0, 9 + len(form)) in candidates("write to " + form), form
    assert candidates("x at y.z at mail.com") == [(0, 0, 8), (5, 0, 20)]


def corpus():
    rnd = random.Random(6)
    rows = []
    for k in range(400):
        digits = [rnd.randint(0, 9) for _ in range(15)]
        card = next(s for d in "0123456789" if luhn(s := "".join(map(str, digits)) + d))
        parts = [f"name{k}@mail.example.com", f"{k % 256}.7.8.9", card, f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", "a year 2024 at home", card[:-1] + str((int(card[-1]) + 3) % 10)]
        rows.append((k, "some words " + " and ".join(rnd.sample(parts, 3)) + " more."))
    return rows


def test_learned_spans(spark):
    model = train(spark.createDataFrame(corpus(), "doc_id long, text string"))
    clean = ["room 12 34 on 2024-01-05 10 20", "at home. It is at a place", "999.1.1.1", "", "version 1.2.3", "8 of 20 in 2020"]
    assert all(spans(t, model)[1] == base_spans(t) for t in clean)
    text = "card 4539.1488.0343.6467 or jane.doe (at) mail (dot) example (dot) com"
    base, every = spans(text, model)
    assert not base and joined(every) == "card:5:24,email:28:70"
    assert redacted(text, every) == "card [CARD] or [EMAIL]"


def test_real_data_in_other_forms_does_not_teach_to_reject(spark):
    rnd = random.Random(8)
    rows = corpus()
    cards = [next(s for d in "0123456789" if luhn(s := body + d)) for body in (str(rnd.randint(10**14, 10**15 - 1)) for _ in range(800))]
    for k, card in enumerate(cards):
        dotted = ".".join(card[i : i + 4] for i in range(0, 16, 4))
        rows.append((1000 + k, f"some words {dotted} and jack{k} (at) mail (dot) com and 2001:db8:0:0:0:0:{k:x}:1 here, call 06 12 34 {k % 90 + 10} 78 more."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = "card 4539.1488.0343.6467 or jane.doe (at) mail (dot) example (dot) com or fe80:0:0:0:1:2:3:4 ok"
    base, every = spans(text, train(docs))
    assert not base and joined(every) == "card:5:24,email:28:70,ip:74:92"
    assert not any(row[-1] == 0 and row[:1] == [2.0] and row[8] for row in training_rows(rows[-1][1]))


def planted(rnd, k):
    """A line with one datum in a disguise and what it is, or a line that only looks like one."""
    digits = "".join(str(rnd.randint(0, 9)) for _ in range(15))
    card = next(s for d in "0123456789" if luhn(s := digits + d))
    name = f"{rnd.choice(['jo', 'max', 'li', 'ana'])}{k}"
    sep = rnd.choice([".", "/"])
    number = f"{rnd.randint(200, 989)}"
    real = [(0, f"{name} (at) mail (dot) net"), (0, f"{name}[at]web.org"), (2, sep.join(card[i : i + 4] for i in range(0, 16, 4))),
            (1, f"2001:db8:0:0:{k % 9}:0:{k:x}:1"), (3, f"({number}) 555-{rnd.randint(1000, 9999)}")]
    broken = card[:-1] + str((int(card[-1]) + 3) % 10)
    false = [f"on 2024-0{k % 9 + 1}-12 10 20 30", ".".join(broken[i : i + 4] for i in range(0, 16, 4)), f"meet {name} at Port. Then home", f"300.{k % 256}.1.2", f"rows {k} 20 30"]
    if k % 2:
        return rnd.choice(false), None
    kind, body = rnd.choice(real)
    cue = {3: "call "}.get(kind, "see ")
    return f"{cue}{body}", (len(cue), kind, len(cue) + len(body))


def test_disguised_data_that_was_planted(spark):
    """Precision and recall of what the trees add, on lines they have not seen."""
    model, rnd = train(spark.createDataFrame(corpus(), "doc_id long, text string")), random.Random(12)
    hit = added = wanted = 0
    for k in range(2000):
        body, datum = planted(rnd, k)
        text = f"some words and {body} or more words"
        base, every = spans(text, model)
        new = [s for s in every if s not in base]
        expected = datum and (datum[0] + 15, datum[1], datum[2] + 15)
        added += len(new)
        wanted += expected is not None
        hit += expected in every
    print(f"precision {hit / added:.3f}, recall {hit / wanted:.3f}")
    assert hit / added >= 0.95 and hit / wanted >= 0.8


def unseen(rnd, k):
    """The same with forms, groupings and words that training never makes."""
    digits = "".join(str(rnd.randint(0, 9)) for _ in range(14))
    card = next(s for d in "0123456789" if luhn(s := "4" + digits + d))
    name, tail = f"{rnd.choice(['jo', 'max', 'li', 'ana'])}.{k}", "".join(str(rnd.randint(0, 9)) for _ in range(9))
    grouped = rnd.choice([f"0{tail[:3]} {tail[3:6]} {tail[6:]}", f"0{tail[:2]}/{tail[2:5]}-{tail[5:]}", f"{tail[:2]} {tail[2:5]} {tail[5:7]} {tail[7:]}"])
    real = [(0, "", f"{name} {{at}} mail {{dot}} net"), (0, "courriel ", f"{name} AT web DOT org"), (0, "", f"{name}<at>web.co.uk"), (2, "tarjeta ", "/".join((card[:4], card[4:8], card[8:12], card[12:]))),
            (2, "mastercard ", ".".join((card[:6], card[6:11], card[11:]))), (3, rnd.choice(["mobile ", "téléphone ", "Handy ", "móvil: "]), grouped)]
    broken = card[:-1] + str((int(card[-1]) + 3) % 10)
    false = [(rnd.choice(["serial ", "isbn ", "commande ", "tracking ", "page "]), grouped), (rnd.choice(["serial ", "pedido "]), f"({tail[:3]}) {tail[3:6]}-{tail[5:]}"), ("tarjeta ", "/".join((broken[:4], broken[4:8], broken[8:12], broken[12:]))),
             ("", f"{name} at home. Dot by dot"), ("", f"1{k % 10}.12.2023 10 20 30"), ("", grouped), ("servidor ", f"10.300.{k % 256}.7")]
    if k % 2:
        cue, body = rnd.choice(false)
        return cue + body, None
    kind, cue, body = rnd.choice(real)
    return cue + body, (len(cue), kind, len(cue) + len(body))


def test_forms_and_words_that_were_held_out(spark):
    model, rnd = train(spark.createDataFrame(corpus(), "doc_id long, text string")), random.Random(21)
    hit = added = wanted = 0
    for k in range(2000):
        body, datum = unseen(rnd, k)
        base, every = spans(f"some words and {body} or more words", model)
        added += sum(s not in base for s in every)
        wanted += datum is not None
        hit += bool(datum) and (datum[0] + 15, datum[1], datum[2] + 15) in every
    print(f"held out: precision {hit / added:.3f}, recall {hit / wanted:.3f}")
    assert hit / added >= 0.95 and hit / wanted >= 0.8
    for text, want in {"jane AT mail DOT com": "email:0:20", "call 0664 123 4567": "phone:5:18", "my number is 0664 123 4567": "phone:13:26", "Telefon 0664 123 4567": "phone:8:21", "order (120) 345-6789 shipped": ""}.items():
        assert joined(spans(text, model)[1]) == want, text


def boosted(x, y, rounds, rate, depth):
    """Trees over all cuts by plain loops: the splits with the best gain, first feature and cut on ties."""
    prior = math.log(y.mean() / (1 - y.mean()))
    score = [prior] * len(y)

    def leaf(rows, g, h, left):
        total_g, total_h = sum(g[r] for r in rows), sum(h[r] for r in rows)
        best = (1e-6, None)
        if left and len(rows) >= 8:
            for k in range(len(x[0])):
                for cut in np.unique(np.quantile([v[k] for v in x], np.linspace(0, 1, 32)))[:-1]:
                    low = [r for r in rows if x[r][k] <= cut]
                    a, b = sum(g[r] for r in low), sum(h[r] for r in low)
                    gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (k, cut))
        if best[1] is None:
            return {r: -rate * total_g / (total_h + 1) for r in rows}
        k, cut = best[1]
        return leaf([r for r in rows if x[r][k] <= cut], g, h, left - 1) | leaf([r for r in rows if x[r][k] > cut], g, h, left - 1)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        step = leaf(list(range(len(y))), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], depth)
        score = [s + step[r] for r, s in enumerate(score)]
    return [1 / (1 + math.exp(-s)) for s in score]


def test_trees_against_plain_loops():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.1) ^ (rng.random(120) < 0.1)).astype(float)
    assert np.allclose(Trees().fit(x, y, rounds=5, depth=3).predict(x), boosted(x, y, 5, 0.2, 3), atol=1e-6)


def test_calibration_against_every_threshold():
    rng = np.random.default_rng(4)
    for _ in range(200):
        score, label = rng.random(40).round(2), (rng.random(40) < 0.7).astype(float)
        got = calibrate(score, label, 0.8, 0.3)
        chosen = [t for t in range(1, 41) if label[np.argsort(-score, kind="stable")][:t].mean() >= 0.8 and np.sort(score)[::-1][t - 1] >= 0.3]
        if not chosen:
            assert got == 2.0
        else:
            ordered = np.sort(score)[::-1]
            below = ordered[chosen[-1]] if chosen[-1] < 40 else 0.0
            assert got == pytest.approx(max(0.3, (ordered[chosen[-1] - 1] + below) / 2))


def test_ties_go_to_the_first_and_longest():
    sure = PiiModel(Trees(5.0, [np.array([[-1, 0.0, 0, 0]])]), [0.5] * 4)
    text = "a 1111 222 333 444 b"
    spans_of = spans(text, sure)[1]
    first = min(c[0] for c in candidates(text))
    assert spans_of[0] == max((c for c in candidates(text) if c[0] == first), key=lambda c: (c[2], -c[1]))


def test_find(spark):
    rows = [(1, "me a@b.co", 1), (2, None, 2), (None, "", 3), (4, "x " * 200_000 + "1.2.3.4", 4), (4, "nothing", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    model = train(docs)
    got = find(docs, model).collect()
    assert sorted((r.id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in got) == [
        (0, 0, 0, 0, 0, ""), (1, 1, 0, 0, 0, "email:3:9"), (2, 0, 0, 0, 0, ""), (4, 0, 0, 0, 0, ""), (4, 0, 1, 0, 0, "ip:400000:400007")]
    assert {r.base_sha256 for r in got if not r.spans} == {hashlib.sha256(b"").hexdigest()}
    assert find(docs.limit(0), train(docs.limit(0))).collect() == [] and KINDS[3] == "phone"


def test_documents_beyond_any_sample_teach(spark):
    """All personal data are in the documents that come last by the hash of their ids, after 4200 with digits alone."""
    ids = [r.id for r in spark.range(4600).orderBy(F.xxhash64("id")).collect()]
    rows = [(k, f"page {k}") for k in ids[:4200]] + [(k, text) for k, (_, text) in zip(ids[4200:], corpus())]
    text = "card 4539.1488.0343.6467 or jane.doe (at) mail (dot) example (dot) com"
    assert joined(spans(text, train(spark.createDataFrame(rows, "doc_id long, text string")))[1]) == "card:5:24,email:28:70"


def test_every_training_row_is_counted(spark, monkeypatch):
    monkeypatch.setattr(pii, "COUNTED_ROWS", 50)  # counts are passed on in parts
    texts = [t for _, t in corpus()] * 3 + [None, "", "no data", "x " * 50_000 + " 1.2.3.4 or 300.1.2.3 " * 300]
    docs = spark.createDataFrame([(None if k % 5 else 1, t) for k, t in enumerate(texts)], "doc_id long, text string")
    wanted = Counter(tuple(row) for t in texts for row in training_rows(t or ""))
    got = pii.counted_rows(docs).collect()
    assert sum(r.n for r in got) == sum(wanted.values()) > 20_000
    both = Counter()
    for r in got:
        both[(*r.x, 1.0)] += r.good
        both[(*r.x, 0.0)] += r.n - r.good
    assert +both == wanted and {r.held for r in got} == {False, True}


def counted(spark, n=3000):
    rng = np.random.default_rng(5)
    x = rng.integers(0, [4, 60, 3, 2, 9], (n, 5)).astype(float)
    rows = rng.integers(1, 40, n)
    good = rng.binomial(rows, np.where((x[:, 0] > 1) ^ (x[:, 1] < 17), 0.97, 0.02))
    table = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, rows, good)], "x array<double>, n long, good long")
    return table, x, rows, good


def test_counts_in_spark_give_the_trees_of_single_rows(spark):
    table, x, n, good = counted(spark)
    every = np.repeat(x, n, axis=0)
    label = np.concatenate([[1.0] * g + [0.0] * (k - g) for k, g in zip(n, good)])
    cuts = pii.quantile_cuts(table, x.shape[1])
    assert all(np.allclose(c, np.unique(np.quantile(every[:, k], np.linspace(0, 1, 32)))[:-1]) for k, c in enumerate(cuts))
    with pii.scratch():
        spread = Trees().grow(pii.TableRows(table.repartition(7)), cuts, rounds=3)
    here = Trees().grow(pii.LocalRows(x, n.astype(float), good.astype(float)), cuts, rounds=3)
    assert spread.prior == here.prior and all(np.array_equal(a, b) for a, b in zip(spread.trees, here.trees, strict=True))
    assert np.allclose(here.predict(x), Trees().fit(every, label, rounds=3).predict(x), atol=1e-5)


def test_thresholds_are_of_all_held_out_rows(spark):
    table, x, n, good = counted(spark)
    trees = Trees().grow(pii.LocalRows(x, n.astype(float), good.astype(float)), pii.quantile_cuts(table, x.shape[1]))
    score = trees.predict(x)
    for kind, got in enumerate(pii.thresholds(table, trees)):
        own = (x[:, 0] == kind) & (score >= got)
        steps = np.floor(trees.margin(x) * pii.STEPS)
        if got <= 1:
            assert good[own].sum() / n[own].sum() >= 0.995
        for step in set(steps[(x[:, 0] == kind) & ~own & (score >= 0.95 + 1e-3)]):
            more = (x[:, 0] == kind) & (steps >= step)
            assert good[more].sum() / n[more].sum() < 0.995
