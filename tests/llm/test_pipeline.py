from __future__ import annotations

import random
import re
from pathlib import Path

import corpus_pipeline as C
from test_packing import check
from test_simhash import brute
from test_substrings import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], SCHEMA)


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage(spark, tmp_path):
    """Every stage on what its predecessor kept, against the plain version of its decisions."""
    rnd = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    texts = dict(zip(docs.doc_id.tolist(), docs.text.tolist()))
    passage = " ".join(rnd.choices(texts[0].split(), k=70))
    texts |= {9001: None, 9002: "", 9003: "12 34", 9004: texts[5], 9005: texts[6] + " " + passage, 9006: texts[8] + "\n" + passage, 9007: "me@mail.example.com the and of that"}
    df = frame(spark, texts)
    for name, stage in C.STAGES:
        before = rows(df)
        out = stage(spark, df, None)
        if name == "packing":
            n, total = check(out.collect(), before, 1024)
            assert n <= total / 1024 * 1.05 + 1
            break
        assert out.schema == df.schema
        out.write.parquet(path := str(tmp_path / name))
        df = spark.read.parquet(path)
        after = rows(df)
        if name == "language_id":
            assert before.keys() - after.keys() >= {9001, 9002, 9003} and len(after) >= len(before) - 6
        elif name == "near_dedup":
            assert after == {k: before[k] for k, (_, c) in brute(list(before.items())).items() if k == c}
        elif name == "substring_dedup":
            keys = list(before)
            found = dict(zip(keys, plain([before[k] for k in keys], 35)))
            assert after == {k: kept if gone else before[k] for k, (_, gone, kept) in found.items()}
            assert all(r.n_chars == len(r.text) for r in df.collect())
        else:
            assert after.keys() == before.keys() and "[EMAIL]" in after[9007]
            email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
            assert not any(email.search(t) for t in after.values())
            clean = {k for k, t in before.items() if not re.search(r"[0-9@]", t)}
            assert all(after[k] == before[k] for k in clean)


def test_nulls_repeats_and_an_empty_table(spark):
    clashing = "n_words long, n_removed long, kept string, __lang string, __hash string, __redacted string, __kept string, found_lang string, Redacted string, id long"
    more = (77, 78, "mine", "l", "h", "r", "k", "f", "R", 5)
    wide = [(None, "the cat and the dog", "en", None, None), (1, None, None, "s", 3), (2, "der Hund", "de", "s", 8), (2, "der Hund", "de", "s", 8)]
    df = spark.createDataFrame([(*r, *more) for r in wide], f"{SCHEMA}, {clashing}")
    for table in (df, df.limit(0)):
        now = table
        for _, stage in C.STAGES[:-1]:
            now = stage(spark, now, None)
            assert now.columns == table.columns and all(tuple(r)[5:] == more for r in now.collect())
        packed = C.STAGES[-1][1](spark, now, None).collect()
        assert len(packed) == now.count() == (0 if table is not df else 3)


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    packed = C.run(spark, str(tmp_path)).collect()
    assert len(packed) > 100 and len(set(shared.iterdir()) - before) <= 4
