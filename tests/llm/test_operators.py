"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns; brute force where SQL says nothing."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.llm import chat, decontaminate, jaccard, mixing, quality, tiff, token_counts, toxicity, url_filter, warc
from shapelake.llm.common import Scratch
from shapelake.llm.components import connected_components

DOCS = "doc_id long, text string, source string, score double, component_id long, tokens string"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 0.5, 9, "x") for i, t in rows], DOCS)


def words(rng, n, vocabulary=2_000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- 1 ----------------------------------------------------------------------


def leaks(docs, items, span=12, most=2):
    import re

    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = tok(t)
        for i, b in items:
            v = tok(b)
            hits = [(p, s) for p in range(len(w) - span + 1) for q in range(len(v) - span + 1) if (s := sum(x != y for x, y in zip(w[p : p + span], v[q : q + span], strict=True))) <= most]
            if hits:
                out[d, i] = (len(hits), min(p for p, _ in hits), max(p for p, _ in hits) + span, min(s for _, s in hits))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate((11, 12, 13, 30, 30))] + [(9, None), (10, "")]
    rows = [(0, None), (1, ""), (2, " ".join(words(rng, 5)))]
    for k in range(40):
        body = words(rng, 60)
        item = items[k % 5][1].split()
        for at in rng.sample(range(len(item)), k % 4):
            item[at] = "changed"
        body[20:20] = [w.upper() + "," for w in item]
        rows.append((10 + k, " ".join(body)))
    rows.append((10, rows[5][1]))  # an id that occurs twice
    got = decontaminate.overlaps(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=20).collect()
    want = leaks([r for r in rows[:-1]], items)
    again = leaks([(10, rows[-1][1])], items)
    for key, v in again.items():
        old = want.get(key, (0, 10**9, 0, 10**9))
        want[key] = (old[0] + v[0], min(old[1], v[1]), max(old[2], v[2]), min(old[3], v[3]))
    assert {(r.doc_id, r.item_id): tuple(r)[2:] for r in got} == want


def test_decontamination_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.overlaps(documents(spark, []), items).count() == 0
    docs = documents(spark, [(1, "a b c"), (None, None)])
    assert decontaminate.remove_contaminated(docs, items.limit(0)).columns == docs.columns
    assert decontaminate.remove_contaminated(docs, items).count() == 2


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_only_contaminated_rows_go_whatever_their_ids(spark, most):
    leak = " ".join(f"q{k}" for k in range(12))
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(None, leak), (None, "clean text"), (None, None), (4, "x " + leak), (4, "clean too"), (5, leak + " y"), (6, "clean as well"), (7, leak), (7, leak + " z")]
    got = decontaminate.remove_contaminated(documents(spark, rows), items, broadcast_ids=most).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "clean text"), (4, "clean too"), (6, "clean as well")]


# --- 2 and 6 ----------------------------------------------------------------


def labelled(spark, n=240):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        good, bad = k % 5 != 0, k % 4 == 0
        w = words(rng, rng.randrange(20, 80))
        if bad:
            w[5:5] = [rng.choice(["idiot", "moron", "scum"]) + rng.choice(["", "ish", "ly"]) for _ in range(3)]
        text = " ".join(w if good else [x.upper() + "!!" for x in w])
        docs.append((k, text))
        labels.append((k, int(good), int(bad)))
    extra = [(1_000, None), (1_001, ""), (None, "w1 w2"), (1_002, "word " * 200_000), (0, docs[0][1])]
    return documents(spark, docs + extra), spark.createDataFrame([*labels, (None, 1, 1), (3, None, 7)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, column):
    docs, labels = labelled(spark)
    train = labels.where("doc_id % 3 <> 1 OR doc_id IS NULL")
    got = module.classify(docs, train).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {r.doc_id: r[column] for r in labels.where(f"{column} IN (0, 1)").collect() if r.doc_id is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.9
    again = {(r.doc_id, r.score) for r in module.classify(docs, train).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


@pytest.mark.parametrize(("module", "column", "empty"), [(quality, "quality", 0.5), (toxicity, "toxic", 0.0)])
def test_classifiers_without_or_with_one_kind_of_label(spark, module, column, empty):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in module.classify(docs, labels.limit(0)).collect()} == {empty}
    assert {r.score for r in module.classify(docs, labels.where(f"{column} = 1")).collect()} == {1.0}
    assert module.classify(docs.limit(0), labels).count() == 0


def test_nnpu_recovers_both_classes_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1.5, 1, (400, 3)), rng.normal(-1.5, 1, (400, 3))
    model = quality.fit_nnpu(p[:200], np.concatenate([p[200:], n[:200]]), 0.5)
    assert (model.score(p) > 0.5).mean() > 0.9
    assert (model.score(n) < 0.5).mean() > 0.9


def maximal(scores):
    """By the recursive definition: the best segment, then the same left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, _, a, b = best
    return maximal(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in maximal(scores[b:])]


def test_maximal_segments_equal_their_definition():
    rng = random.Random(3)
    for _ in range(300):
        # powers of two and their sums: no ties between segments
        scores = [rng.choice([-1, 1]) * rng.random() for _ in range(rng.randrange(0, 14))]
        got = toxicity.maximal_segments(np.array(scores, float))
        want = maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_extreme_value_parameter_solves_its_equation():
    lam, k = toxicity.extreme_value([(0.01, 4.0), (0.002, 6.0)], -0.5)
    assert 0.988 * np.exp(-0.5 * lam) + 0.01 * np.exp(4 * lam) + 0.002 * np.exp(6 * lam) == pytest.approx(1, abs=1e-6)
    assert lam > 0 and 0 < k <= 1


# --- 3 ----------------------------------------------------------------------


def components(rows, percent, size):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(d, set()).update({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if all_ and 100 * both >= percent * all_:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("percent", "size", "hot"), [(90, 3, 1024), (80, 5, 2), (60, 1, 1024), (95, 2, 2), (50, 1, 2), (30, 2, 1024)])
def test_jaccard_components_equal_brute_force(spark, percent, size, hot):
    rng = random.Random(percent)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "É é"), (7, "é é")]
    for family in range(12):
        base = words(rng, rng.choice([8, 10, 12, 20, 40, 90, 300]), 5_000)
        for copy in range(rng.randrange(2, 14)):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
            rows.append((100 * family + 50 + copy, " ".join(text if copy % 3 else base)))
    got = jaccard.similar(documents(spark, rows), percent=percent, words=size, block=3, hot_nodes=hot).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, percent, size)


def test_jaccard_with_shuffled_joins_and_repeated_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, "A B C D E"), (8, "other words in here now"), (None, "alone here")]
    got = jaccard.similar(documents(spark, rows), broadcast_rows=0).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 5), (8, 8)]
    docs = documents(spark, rows)
    kept = jaccard.keep_one(docs, percent=80, words=5)
    assert kept.columns == docs.columns
    assert jaccard.similar(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_one_document_of_each_component_stays_whatever_the_ids(spark, most):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(3, a), (5, a), (5, b), (9, b), (None, a), (None, "alone here"), (None, None), (None, " "), (5, None), (11, c), (12, c), (12, c)]
    docs = documents(spark, rows)
    kept = jaccard.keep_one(docs, percent=80, words=5, broadcast_rows=most)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, " "), (0, "alone here"), (3, a), (5, ""), (5, b), (11, c)]


def linked_sets(rng, rule, sizes, times):
    """Pairs of sets that link, nested ones exactly at the threshold among them."""
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in sizes:
        for k in range(times):
            base = np.unique(fresh(n))
            if k % 2:
                other = base[rng.permutation(n)[: -(-n * rule.num // rule.den)]]
            else:
                apart = rule.most_apart(n, n)
                drop = rng.integers(0, apart + 1)
                other = np.concatenate([base[: n - drop], fresh(max(0, int(rng.integers(0, apart - drop + 1))))])
            other = np.unique(other)
            both = len(np.intersect1d(base, other))
            if len(other) and rule.den * both >= rule.num * (n + len(other) - both) and len(np.setxor1d(base, other)):
                yield (base, other) if k % 3 else (other, base)


@pytest.mark.parametrize("percent", [17, *range(30, 100, 5)])
def test_pieces_of_linked_sets_always_meet(percent):
    rng = np.random.default_rng(percent)
    rule = jaccard.Rule(percent, 100, 3)
    edges = [int(x) + k for x in rule.lows[3:12] if x < 600 for k in (-1, 0, 1)]
    for one, two in linked_sets(rng, rule, [*edges, 10, 57, 400], 6):
        first, second = ({k for keys, _ in jaccard.piece_keys(x, rule) for k in keys.tolist()} for x in (one, two))
        assert first & second
        # of all the finer pieces, as many as one can spare may be hot
        other = {k for keys, _ in jaccard.piece_keys(two, rule, pieces_each=jaccard.FINE, whole=True) for k in keys.tolist()}
        left = set()
        for keys, spare in jaccard.piece_keys(one, rule, pieces_each=jaccard.FINE, whole=True):
            left |= set(sorted(keys.tolist(), key=lambda k: k not in other)[spare:])
        assert left & other


def test_sets_with_equal_numbers_are_told_apart(spark, monkeypatch):
    true = jaccard.fingerprint
    # with the first seed, all sets have one number
    monkeypatch.setattr(jaccard, "fingerprint", lambda h, seed: (7, true(h, seed)[1]) if seed == 0 else true(h, seed))
    rows = [(1, "a b c d e"), (2, "A b c d e"), (3, "f g h i j"), (4, "k l m")]
    got = jaccard.similar(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_passage_that_many_share_costs_rows_in_proportion(spark, monkeypatch):
    rng = random.Random(8)
    passage = " ".join(words(rng, 70, 10**6))
    written, write = [], Scratch.write

    def counted(self, df, tag):
        out = write(self, df, tag)
        written[-1] += out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    for n in (300, 1200):
        rows = [(k, " ".join(words(rng, 12, 10**6)) + f" {passage} " + " ".join(words(rng, 13, 10**6))) for k in range(n)]
        rows += [(n + k, rows[k][1] + " more") for k in range(20)]
        written.append(0)
        got = jaccard.similar(documents(spark, rows), percent=80, words=5, hot_nodes=50, block=16).collect()
        assert {r.doc_id: r.component_id for r in got} == {k: k % n for k in range(n + 20)}
    assert written[1] < 5 * written[0]


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (15, 3)]
    with Scratch(spark) as scratch:
        got = connected_components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()
        none = connected_components(spark.createDataFrame([], "u long, v long"), scratch).count()
    assert {r.node: r.root for r in got} == {k: 1 for k in (1, 2, 3, 10, 11, 12, 13, 14, 15)} | {4: 4, 5: 4}
    assert none == 0


# --- 4 ----------------------------------------------------------------------


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.range(400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    with Scratch(spark) as scratch, pytest.raises(RuntimeError):
        connected_components(chain, scratch, rounds=2)


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")]
    urls = ["http://A.Example.NET/en/1", "http://example.net/de/1", "http://x.net", "http://badexample.net/en/", "https://porn.example.com/", "https://pornography.example.com/", "http://free-win.example.org/x", "http://free-free.example.org/x", "http://porn.example.org/fr/", "no host porn", None, "", "://h?p=1", "http://h#/a"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules=rules).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/1", "net/", "block")
    assert got[2] == ("x.net", "", None, "allow")
    assert got[3][2:] == ("net/", "block")
    assert got[4][2:] == (None, "block") and got[5][2:] == (None, "allow")
    assert got[6][3] == "block" and got[7][3] == "allow"
    assert got[8][2:] == ("org/fr/", "allow")
    assert got[9] == ("", "", None, "block") and got[10] == ("", "", None, "allow") and got[11] == ("", "", None, "allow")
    assert got[12][:2] == ("h", "") and got[13][:2] == ("h", "")
    assert url_filter.filter_urls(pages.limit(0), rules=rules).count() == 0


# --- 5 ----------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|im_end|>", "\n\n lead", "trail \n\n", "", None, "\\n", "é😀<|", "a\\\\b"]
    rows = [(1, k, ("user", "assistant")[k % 2], t, "x") for k, t in enumerate(odd)] + [(1, len(odd) + k, "assistant", t, "x") for k, t in enumerate(odd)]
    rows += [(2, 0, "sys\ntem<|im_end|>", "one", "x"), (2, 0, None, "two", "x"), (None, None, "assistant", "null id", "x"), (3, 5, "assistant", "same", "x"), (3, 5, "assistant", "same", "x"), (4, 0, "assistant", "long " * 100_000, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chats(frame)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    for conv in (1, 2, None, 3, 4):
        turns = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        spoken = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
    assert chat.digest(chat.format_chats(frame.limit(0))).count() == 0


def test_token_spans_under_the_mask_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        cuts = sorted(rng.sample(range(40), 8))
        spans = np.array(cuts).reshape(-1, 2)
        ends = np.cumsum([rng.randrange(0, 4) for _ in range(20)])
        starts = np.concatenate(([0], ends[:-1]))
        want = [any(max(a, s) < min(b, e) for a, b in spans) for s, e in zip(starts, ends, strict=True)]
        assert chat.overlapping(spans[:, 0], spans[:, 1], starts, ends).tolist() == want


# --- 7 ----------------------------------------------------------------------


def test_warc_round_trip_over_many_splits(spark):
    rng = random.Random(7)
    big = "".join(rng.choices("abcdefgh ", k=5_000))
    nested = warc.record(99, "http://x/", b"inner " * 50, None).decode("latin-1")
    html = [None, "", "short", "short", big, big, "é" * 600, nested, "".join(rng.choices("xyz\x1f\x8b\x08", k=40_000)), big]
    pages = spark.createDataFrame([(k, "http://a/\n", h, "clash") for k, h in enumerate(html)] + [(9, "http://a/", big, "clash")], "page_id long, url string, html string, refers_to string")
    with Scratch(spark) as scratch:
        folder = scratch.path("warc")
        archives = warc.write_warc(warc.refer(pages), folder, roll=4_000)
        for split in (37, 1_000, 1 << 20):
            records = warc.read_warc(warc.archives_in(spark, folder), split_bytes=split)
            got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(records).collect())
            want = []
            for k, h in [*enumerate(html), (9, big)]:
                data = (h or "").encode()
                refers = 9 if h == big and k != 9 else None
                want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
            assert got == sorted(want)
        assert archives.count() >= 2
        assert warc.write_warc(warc.refer(pages.limit(0)), scratch.path("none")).count() == 0


def test_attempts_that_get_rows_in_another_order_leave_each_page_once(spark, tmp_path):
    """A first attempt of every task writes other rows and is not committed."""
    folder = str(tmp_path / "warc")
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"), F.lit(None).cast("long").alias("refers_to")).repartition(3)
    committed = warc.write_warc(pages, folder, roll=700)
    names = {r.path for r in committed.collect()}
    warc.write_warc(pages.orderBy(F.desc("page_id")).where("page_id % 2 = 0"), folder, roll=900)  # another writer's index is the committed one now
    index = warc.write_warc(pages, folder, roll=500)
    got = sorted(r.page_id for r in warc.digest(warc.read_warc(index)).collect())
    assert got == list(range(200)) and not names & {r.path for r in index.collect()}
    assert sorted(r.page_id for r in warc.digest(warc.read_warc(warc.archives_in(spark, folder))).collect()) == got


@pytest.mark.parametrize("few", [0, 10])
def test_references_with_and_without_a_broadcast(spark, few):
    big, other = "x" * 1000, "y" * 1000
    rows = [(1, big), (5, big), (3, big), (2, other), (7, "small"), (8, "small"), (None, other), (5, big), (9, None)]
    pages = spark.createDataFrame([(i, None, t) for i, t in rows], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.refers_to) for r in warc.refer(pages, broadcast_rows=few).collect()), key=str)
    assert got == sorted([(1, 5), (5, None), (3, 5), (2, None), (7, None), (8, None), (None, 2), (5, None), (9, None)], key=str)


def test_warc_reader_skips_damage():
    import io

    parts = [warc.record(k, "u", bytes([65 + k]) * 3_000, None) for k in range(3)]
    data = parts[0] + b"\x1f\x8b\x08garbage" + parts[1][:-5] + b"\0" * 40 + parts[2]
    found = list(warc.members(warc._Bytes(io.BytesIO(data), len(data)), 0, len(data)))
    assert [c and warc.parse_headers(c)[0]["warc-record-id"] for _, c in found] == ["<urn:page:0>", None, "<urn:page:2>"]
    assert found[1][0] == len(parts[0])


# --- 8 ----------------------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_equals_brute_force(rule):
    rng = random.Random(8)
    for _ in range(200):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(rng.randrange(1, 20))])
        bounds = np.unique([0, ends[-1], *(rng.randrange(ends[-1] + 1) for _ in range(4))])
        want = np.zeros(len(bounds) - 1)
        for s, e in zip([0, *ends[:-1]], ends, strict=True):
            share = [max(0, min(b, e) - max(a, s)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            if rule == "split":
                want += np.array(share) / (e - s)
            elif rule == "majority":
                want[int(np.argmax(share))] += 1
            else:
                held = [k for k, v in enumerate(share) if v]
                want[held[0] if rule == "start" else held[-1]] += 1
        assert token_counts.allocate(ends, bounds, rule)[0] == pytest.approx(want)


def test_token_counts_against_another_tokenizer_library(spark):
    from tokenizers import Tokenizer

    rows = [(1, "one line\nand\n\nanother é😀 line\n"), (2, None), (3, ""), (4, "\n"), (None, "x"), (1, "again"), (5, "word " * 50_000), (6, "a\n \n  b")]
    got = {}
    single = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    for r in token_counts.section_token_counts(documents(spark, rows), vocabulary=single).collect():
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.section, r.start_char, r.n_chars, r.n_tokens))
    tok = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    for d, t in rows:
        t = t or ""
        enc = tok.encode(t, add_special_tokens=False)
        lines = t.splitlines(keepends=True) if t else [""]
        starts = np.cumsum([0, *map(len, lines)])
        want = np.zeros(len(lines))
        for s, _ in enc.offsets:
            want[int(np.searchsorted(starts, s, "right")) - 1] += 1
        mine = sorted(got[d, len(enc.ids)])
        assert [m[1:3] for m in mine] == [(int(a), len(x)) for a, x in zip(starts, lines, strict=False)]
        assert [m[3] for m in mine] == want.tolist()


# --- 9 ----------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(words(rng, rng.randrange(0, 40))), s) for k in range(3_000) for s in [("a", "b", "c", None)[0 if k % 3 == 0 else k % 4]]]
    rows += [(5_000, None, "z"), (5_001, "", "z"), (None, "x y", "b")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(7)).collect()))
    size, target, taken = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6
        assert taken[s] == pytest.approx(target[s], abs=3)
    assert mixing.mix(frame.limit(0)).count() == 0


# --- 10 ---------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 64])
def test_tiff_round_trip(compression, predictor, tile):
    rng = random.Random(10)
    for n in (1, 3, 170, 171, 700):
        for payload in (bytes(rng.choices(b"abc  \n", k=192 * n)), rng.randbytes(192 * n), b" " * 192 * n):
            media = tiff.encode_page(payload, compression=compression, predictor=predictor, tile=tile)
            (order, fields), = tiff.directories(media)
            image, said = tiff.decode_page(media, order, fields)
            assert image.tobytes() == payload and said["layout"] == ("tiles" if tile else "strips")


def test_tiff_codes_by_hand():
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(tiff.packbits_encode(b"aaab" * 99 + b"c" * 300)) == b"aaab" * 99 + b"c" * 300
    # clear, 7, 258, 8, 8, 258, 6, 6, stop in nine-bit codes
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_tiff_pages_of_either_byte_order_and_damage(spark):
    import struct

    def page(order, at, nxt):
        fields = [(256, 4, 2), (257, 4, 1), (258, 3, 16), (259, 3, 1), (273, 4, max(at - 4, 0)), (277, 3, 1), (278, 4, 1), (279, 4, 4)]
        body = struct.pack(f"{order}H", len(fields))
        for tag, kind, value in fields:
            body += struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
        return body + struct.pack(f"{order}I", nxt)

    def two(order, mark):
        size = len(page(order, 0, 0))
        first, second = 12, 12 + size + 4
        pixels = struct.pack(f"{order}HH", 1, 500)
        return mark + struct.pack(f"{order}HI", 42, first) + pixels + page(order, first, second) + pixels + page(order, second, first)

    rows = [(1, two("<", b"II"), "x"), (2, two(">", b"MM"), "x"), (3, b"nothing", "x"), (4, None, "x"), (5, two("<", b"II")[:30], "x"), (None, two("<", b"II"), "x")]
    got = tiff.read_pages(spark.createDataFrame(rows, "id long, media binary, page string")).collect()
    pages = [(r.id, r.page, np.frombuffer(r.pixels, "u2").tolist()) for r in got if not r.error]
    assert sorted(pages, key=str) == sorted([(i, p, [1, 500]) for i in (1, 2, None) for p in (0, 1)], key=str)
    assert sorted(r.id for r in got if r.error) == [3, 5]


def test_tiff_digest(spark):
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "x" * 193), (5, "word " * 60_000), (6, "x" * 193), (None, "n")]
    got = {r.doc_id: r for r in tiff.digest(tiff.texts_to_tiff(documents(spark, rows))).collect()}
    for d, t in rows:
        data = (t or "").encode()
        padded = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert got[4].asDict() | {"doc_id": 0} == got[6].asDict() | {"doc_id": 0}
    assert tiff.digest(tiff.texts_to_tiff(documents(spark, []))).count() == 0


def test_keys_that_meet_stream_by_in_batches_of_any_size():
    import pyarrow as pa

    rng = random.Random(11)
    for size in (1, 2, 3, 7, 100):
        rows = sorted((rng.randrange(12), rng.randrange(4)) for _ in range(60))
        batches = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows[k : k + size]], pa.int64()) for c in (0, 1)], names=["key", "node"]) for k in range(0, len(rows), size)]
        got = {tuple(r.values()) for b in jaccard._meeting(iter(batches)) for r in b.to_pylist()}
        nodes = {}
        for key, node in rows:
            nodes.setdefault(key, []).append(node)
        assert got == {(key, n, of[0]) for key, of in nodes.items() for n in set(of) - {of[0]}}  # the first is the hub of the others


def test_warc_reader_reports_damage_and_foreign_digests(spark, tmp_path):
    import gzip

    def foreign(digest, kind="revisit"):
        head = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/http; msgtype=response", "Content-Length: 4"]
        return gzip.compress("\r\n".join([*head, *([f"WARC-Payload-Digest: {digest}"] if digest else []), "", ""]).encode() + b"\r\n\r\n\r\n\r\n")

    hexadecimal = hashlib.sha1(b"x").hexdigest()
    stated = ["sha1:" + hexadecimal.upper(), None, "md5:AAAA", "sha1:not base 32", "sha256:" + "a" * 64, hexadecimal]
    data = b"".join(map(foreign, stated)) + b"junk" + foreign(None)[:-9]
    (tmp_path / "a.warc.gz").write_bytes(data)
    records = warc.read_warc(warc.archives_in(spark, str(tmp_path)), split_bytes=1 << 20)
    assert [r.offset for r in records.where("error IS NOT NULL").collect()] == [len(b"".join(map(foreign, stated)))]
    got = warc.digest(records).collect()
    assert sorted(r.payload_digest or "" for r in got) == ["", "", "", "", hexadecimal, hexadecimal]
    assert all(r.page_id is None and r.record_type == "revisit" for r in got)


def test_warc_null_urls_and_ids(spark):
    pages = spark.createDataFrame([(1, None, "a" * 2000), (None, "u", "a" * 2000), (2, None, None), (None, None, "b"), (3, "u", "a" * 2000)], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0), r.refers_to or 0, len(r.html or "")) for r in warc.refer(pages).collect())
    assert got == [(0, 0, 1), (0, 3, 2000), (1, 3, 2000), (2, 0, 0), (3, 0, 2000)]


def test_tiff_damage_gives_error_rows(spark):
    good = tiff.encode_page(b"ab " * 64)
    at = int.from_bytes(good[4:8], "little") + 2

    def changed(tag, kind=None, n=None, value=None):
        out = bytearray(good)
        for k in range(at, len(good), 12):
            if int.from_bytes(good[k : k + 2], "little") == tag:
                for where, size, x in ((2, 2, kind), (4, 4, n), (8, 4, value)):
                    if x is not None:
                        out[k + where : k + where + size] = int(x).to_bytes(size, "little")
                return bytes(out)

    bad = [changed(tiff.WIDTH, n=0), changed(tiff.WIDTH, value=200_000), changed(tiff.HEIGHT, value=2**32 - 1), changed(tiff.WIDTH, kind=11), changed(tiff.SAMPLES, value=0), changed(tiff.BITS, n=2**31), changed(tiff.STRIP_BYTES, value=3), changed(tiff.STRIP_AT, value=10**6), good[:40], good[:-3], b"", b"II*\0", b"MM\0*\0\0\0\x08\xff\xff"]
    media = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate([good, *bad])] + [(99, None)], "id long, media binary")
    got = {r.id: r for r in tiff.read_pages(media).collect()}
    assert got[0].error is None and bytes(got[0].pixels) == b"ab " * 64
    assert set(got) == set(range(len(bad) + 1))
    assert all(r.error and r.pixels is None for k, r in got.items() if k)


def test_tiff_reads_bits():
    bits = np.random.default_rng(1).integers(0, 2, (5, 19)).astype(np.uint8)
    packed = b"".join(tiff.packbits_encode(row.tobytes()) for row in np.packbits(bits, axis=1))
    fields = {tiff.WIDTH: (19,), tiff.HEIGHT: (5,), tiff.BITS: (1,), tiff.COMPRESSION: (tiff.PACKBITS,), tiff.STRIP_AT: (0,), tiff.STRIP_BYTES: (len(packed),)}
    image, said = tiff.decode_page(packed, "<", fields)
    assert (image[:, :, 0] == bits).all() and said["bits"] == 1


def test_chat_of_no_rows_and_of_gaps(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_chats(none)).count() == 0
    # tokens 1-3 and 5-7 of a turn from 0 to 8 are under the mask, 3-5 is not
    starts, ends = np.array([1, 3, 5, 9]), np.array([3, 5, 7, 11])
    assert chat.masked_text("abcdefghijk", [0], [8], [True], starts, ends, np.array([True, False, True, True])) == "bcfg"
