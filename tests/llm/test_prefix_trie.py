"""The trie of conversation prefixes against nodes made one by one."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shapelake.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth long, shared boolean, n long"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True, 2) for r in rows], SCHEMA)


def brute(rows, group=20, heads=4):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [r[2:] for r in sorted(rs)] for c, rs in convs.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + turns[c][h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        yield p
        for k in kids.get(p, []):
            yield from below(k)

    out = set()
    for p, members in nodes.items():
        tokens = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        under = list(below(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in under), sum((len(nodes[q]) - 1) * tokens(q) for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n=150):
    rng, rows = random.Random(seed), []
    for c in range(-30, n):
        if c % 7 == 3:
            continue
        last = rng.choice((1, 2, 3, 6, 9))
        for t in range(last):
            # Few texts, so that prefixes are shared, and at the end sometimes one of its own.
            text = rng.choice(("a b", "a b ", "c", "", None)) if t < last - 1 or rng.random() < 0.5 else f"own {c} {t}"
            rows.append((c, t if rng.random() < 0.97 else None, rng.choice(("user", "user", None)), text))
    rows += [(7 * 20, 0, "user", "tie"), (7 * 20, 0, "user", "tie"), (7 * 20, 0, "a", "tie"), (None, 0, "user", "nobody"), (41, 3, None, "word " * 50_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("widest", [prefix_trie.WIDEST, 1 << 10])
@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_those_made_one_by_one(spark, seed, widest):
    rows = conversations(seed)
    got = prefix_trie.prefix_trie(frame(spark, rows), widest=widest).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r[c] for c in NAMES) for r in got} == brute(rows)


def test_a_conversation_that_is_copied_to_a_third_of_the_ids(spark):
    rows = [(c, t, "user", f"t{t}" if c % 3 == 0 else f"t{t} {c}") for c in range(600) for t in range(3)]
    got = prefix_trie.prefix_trie(frame(spark, rows), heads=1).collect()
    assert {tuple(r[c] for c in NAMES) for r in got} == brute(rows, heads=1)


def test_runs_of_ids_are_hashed_in_order(spark):
    ids = spark.range(20_000).select(F.lit(1).cast("long").alias("x"), F.lit(2).cast("long").alias("y"), F.col("id").alias("conv_id"))
    runs = ids.coalesce(1).mapInArrow(lambda b: prefix_trie._joined_ids(b, 7), "x long, y long, first long, ids string")
    got = runs.orderBy("first").coalesce(1).mapInArrow(prefix_trie._hashed_ids, "x long, y long, ends_sha256 string").collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()]


def test_the_sketch_never_estimates_too_low():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, 400)
    x = np.concatenate((x, x[:100]))
    batches = [pa.RecordBatch.from_arrays([pa.array(p)], names=["x"]) for p in np.array_split(rng.permutation(x), 7)]
    pieces = [p for part in (batches[:3], batches[3:]) for p in prefix_trie._sketched(1 << 10)(iter(part))]
    pieces = sorted((p for b in pieces for p in [b]), key=lambda b: b.column(0)[0].as_py())
    whole = np.zeros(3 * 128, np.uint8)
    for b in prefix_trie._merged(iter(pieces)):
        k = b.column(0)[0].as_py()
        whole[k * 128 : (k + 1) * 128] = np.frombuffer(b.column(2)[0].as_py(), np.uint8)
    sketch = type("S", (), {"value": whole})
    rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(x), 5, np.int32)), pa.array(x), pa.array(x)], names=["depth", "x", "px"])
    shared = np.asarray(next(prefix_trie._screen(sketch, 1 << 10)(iter([rows]))).column(3))
    twice = np.isin(x, x[:100])
    assert shared[twice].all() and (~shared[~twice]).mean() > 0.5


def test_no_conversations(spark):
    empty = prefix_trie.prefix_trie(frame(spark, []))
    assert empty.count() == 0 and tuple(empty.columns) == NAMES
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
