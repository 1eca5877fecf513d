"""Phrase mining against counts of everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from shapelake.llm import collocations
from shapelake.llm.common import Scratch

SCHEMA = "doc_id long, lang string, text string, phrase string, n long, key long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(k, lang, t, "p", 1, 2, 0.5) for k, (lang, t) in enumerate(rows)], SCHEMA)


def counts(rows, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, n


def brute(f, n, support, top):
    found = {k: a for k, a in f.items() if a >= support}
    within = set()
    for (lang, p), a in found.items():
        within |= {(lang, p[i : i + k], a) for k in range(2, len(p)) for i in range(len(p) - k + 1)}
    rows = {}
    for (lang, p), a in found.items():
        if len(p) > 1 and (lang, p, a) not in within:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, rs in rows.items() for rank, (s, a, p, x, y) in enumerate(sorted(rs)[:top], 1)]


def texts(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "\x1cx", "ß", "w1w2", "\x00"]
    fixed = ["New York City Hall", "a\tb  c d e f", "red Red red red"]
    rows = [(None, None), ("en", ""), ("", " \t ,.\n"), ("en", "w1 " * 30_000)]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        rows.append((rng.choice(("en", "de", None, "und")), "".join(p + rng.choice((" ", "  ", "\t", ", ", ".", "\r\n", " ")) for p in parts)))
    return rows


@pytest.mark.parametrize(("seed", "support", "top"), [(1, 3, 2000), (2, 20, 15)])
def test_collocations_equal_counts_of_everything(spark, tmp_path, seed, support, top):
    rows = texts(seed)
    docs = frame(spark, rows)
    want = sorted(brute(*counts(rows), support, top))
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = collocations.collocations(docs, support=support, top=top, broadcast_rows=0).collect()
    assert sorted(tuple(r[c] for c in names) for r in got) == want
    # From many files, so from many shards.
    docs.repartition(9).write.parquet(str(tmp_path / "docs"))
    got = collocations.collocations(spark.read.parquet(str(tmp_path / "docs")), support=support, top=top, shards=5).collect()
    assert sorted(tuple(r[c] for c in names) for r in got) == want


def test_words_are_the_same_however_texts_are_cut(spark, monkeypatch):
    rows = texts(3, 60)
    want = {(lang, p): a for (lang, p), a in counts(rows)[0].items() if a >= 4}
    for name, value in (("CHUNK", 64), ("HELD", 50), ("NAMED", 40)):
        monkeypatch.setattr(collocations, name, value)
    import pyarrow as pa

    class Map:
        value = np.full(collocations.BITS // 8, 255, np.uint8)

    batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" if lang is None else lang for lang, _ in rows]), pa.array([t or "" for _, t in rows]), pa.array([1] * len(rows))], names=["lang", "text", "copies"])
    got = Counter()
    for out in collocations._named_counts(5, [Map] * 5)(iter([batch])):
        for lang, phrase, times in zip(*(c.to_pylist() for c in out.columns), strict=True):
            if phrase is not None:
                got[lang, tuple(phrase.split(" "))] += times
    assert {k: a for k, a in got.items() if a >= 4} == want


def test_exact_beyond_64_bits(spark, monkeypatch):
    a, first, rest, n = 9 * 10**11 + 7, 10**12 + 9, 10**12 + 11, 9 * 10**13 + 1

    def large(docs, scratch, **_):
        return spark.createDataFrame([("en", "x", first), ("en", "y", rest), ("en", "x y", a)], "lang string, phrase string, times long"), spark.createDataFrame([("en", n)], "lang string, n long")

    monkeypatch.setattr(collocations, "frequent_phrases", large)
    got = collocations.collocations(frame(spark, [])).first()
    assert got.score == 1000 * a * n // (first * rest)


def test_every_shard_may_hold_its_share(spark, tmp_path):
    # "p q" is rare in all shards but one, where it is all there is of it.
    rows = [("en", f"a{k} b{k} c") for k in range(300)] + [("en", "p q")] * 6
    spark.createDataFrame([(lang, t) for lang, t in rows], "lang string, text string").coalesce(3).write.parquet(str(tmp_path / "t"))
    with Scratch(spark) as scratch:
        phrases, sizes = collocations.frequent_phrases(spark.read.parquet(str(tmp_path / "t")), scratch, support=6, shards=4)
        assert {(r.phrase, r.times) for r in phrases.collect()} == {("c", 300), ("p", 6), ("q", 6), ("p q", 6)}
        assert sizes.first().n == 912


def test_no_documents(spark):
    got = collocations.collocations(frame(spark, []))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(frame(spark, [(None, None), ("en", "")])).count() == 0


def test_the_last_pass_reads_many_splits_in_a_task(spark, monkeypatch):
    """A task gives a row for each phrase that it meets: splits with the same phrases share tasks, and counts stay."""
    docs = spark.createDataFrame([("en", f"red green blue cyan {k} red green") for k in range(400)], "lang string, text string")
    frames, given = type(docs), []
    real = frames.coalesce
    monkeypatch.setattr(frames, "coalesce", lambda df, n: given.append(n) or real(df, n))
    with Scratch(spark) as scratch:
        found = [{r.phrase: r.times for r in collocations.frequent_phrases(docs, scratch, **how)[0].collect()} for how in ({}, {"words_a_task": 20})]
    assert given == [2 * spark.sparkContext.defaultParallelism, 400 * 7 // 20]
    assert found[0] == found[1]
    assert [found[0][x] for x in ("red", "red green", "red green blue cyan", "green blue")] == [800, 800, 400, 400]
