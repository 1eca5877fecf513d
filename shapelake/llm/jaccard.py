"""Parity-sketch join: sets of word shingles whose Jaccard similarity reaches a threshold.

Let a and b be the sizes of two sets. They reach the similarity num / den only if
their symmetric difference has at most (den - num) (a + b) / (den + num) members.
Each member flips bits in one piece of a sketch, so the pieces that differ are at
most as many as that, and of any more pieces one at least is equal: joining on
pieces, within bands of size, misses no such pair. What meets in a piece is
checked first by the Hamming distance of parity sketches, which is a lower bound
of the symmetric difference, and then by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import count
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_hash, without
from .components import connected_components

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of the whole
    text, A-Z lowered; of the whole sequence if it is shorter; none without words."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, _U)
    joined = b" ".join(parts)
    ends, at = [], 0
    for p in parts:
        at += len(p)
        ends.append(at)
        at += 1
    if len(parts) <= words:
        return np.array([xxhash.xxh3_64_intdigest(joined)], _U)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts, ends[words - 1 :], strict=False)], _U))


@dataclass(frozen=True)
class Rule:
    """Similarity num / den over shingles of ``words`` words; ``seed`` of the fingerprints."""

    num: int
    den: int
    words: int
    seed: int = 0

    def most_apart(self, a, b):
        """Largest symmetric difference that two linked sets of these sizes can have."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest(self, n: int) -> int:
        """Size of the largest set that one of ``n`` members can link with."""
        return n * self.den // self.num

    @cached_property
    def lows(self) -> np.ndarray:
        """Smallest size of each band of sizes. Bands are so wide that linked sets
        lie in one or in two neighbours, whatever the threshold."""
        lows = [1]
        while lows[-1] < 1 << 44:
            lows.append(max(lows[-1] + 1, -(-lows[-1] * 8 // 5), -(-lows[-1] * self.den // self.num)))
        return np.array(lows)


def fingerprint(hashes: np.ndarray, seed: int) -> tuple[int, int]:
    """128 bits for the whole set, as two numbers: sets with equal ones are taken to be equal."""
    with np.errstate(over="ignore"):
        one = mix(hashes ^ mix(np.array([seed], _U))[0])
        size = mix(np.array([len(hashes)], _U))[0]
        return tuple(int(_signed(np.array([np.bitwise_xor.reduce(x) ^ size], _U))[0]) for x in (one, mix(one)))


#: Pieces of a sketch for each piece that may differ: in the first search, and in
#: that among sets that meet in hot keys.
COARSE, FINE = 1.15, 4.0


def piece_keys(hashes: np.ndarray, rule: Rule, *, pieces_each: float = COARSE, whole: bool = False) -> list[tuple[np.ndarray, int]]:
    """Join keys of a set in each band where it can meet others, and how many of them it can spare.

    A set meets those of its own band and larger ones in the next. Of its pieces
    with members it gives the first, by their place, and one more than may differ
    from any set that it can link with in that band: of two linked sets' first
    pieces so taken, one is in both. All of them, if ``whole``: then any of them
    but as many as may differ, and one, can be left out. A set that has too few
    pieces with members gives the empty ones too and can spare none. The lowest
    bit of a key tells odd bands from even ones.
    """
    n, lows, out = len(hashes), rule.lows, []
    home = int(np.searchsorted(lows, n, "right")) - 1
    largest = rule.largest(n)
    with np.errstate(over="ignore"):
        flips = np.concatenate((np.zeros(1, _U), np.bitwise_xor.accumulate(mix(hashes))))
        for band in (home, home + 1):
            if largest < lows[band]:
                break
            top = int(lows[band + 1]) - 1
            most = rule.most_apart(top, top)
            if most == 0:
                continue  # only equal sets link here, and those have one fingerprint
            pieces = ceil(pieces_each * (most + 1))
            cuts = (np.arange(1, pieces, dtype=_U) << _U(32)) // _U(pieces) + _U(1)
            bounds = np.concatenate(([0], np.searchsorted(hashes >> _U(32), cuts, "left"), [n]))
            at, needed = np.flatnonzero(bounds[1:] > bounds[:-1]), rule.most_apart(n, min(top, largest)) + 1
            spare = len(at) - needed
            if spare < 0:
                at, spare = np.arange(pieces), 0
            elif not whole:
                at, spare = at[:needed], 0
            sketch = flips[bounds[at + 1]] ^ flips[bounds[at]]
            keys = mix(sketch ^ mix((_U(band) << _U(40)) + at.astype(_U)))
            out.append((keys & ~_U(1) | _U(band & 1), spare))
    return out


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Bits of which each member flips one; a power of two of at least 2 for each member.

    The sketch for half as many bits is the exclusive or of its two halves.
    """
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    at = (hashes & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all folded to the width of the narrowest."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width // 8), _U)
    for k, s in enumerate(sketches):
        row = np.frombuffer(s, _U)
        while row.nbytes > width:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[k] = row
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


KEYED = "doc_id long, n_shingles long, node long, other long, sketch binary, keys array<long>, text_hash long"


def _keyed(rule: Rule):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64())), ("text_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies that one task reads give their keys once
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sizes, nodes, others, sketches, keys = [], [], [], [], []
                for text in part.column(1):
                    hashes = shingles(text.as_py(), rule.words)
                    node, other = fingerprint(hashes, rule.seed) if len(hashes) else (None, None)
                    fresh = node is not None and node not in seen
                    if fresh:
                        seen.add(node)
                    if len(seen) > 500_000:
                        seen.clear()
                    sizes.append(len(hashes))
                    nodes.append(node)
                    others.append(other)
                    sketches.append(parity_sketch(hashes) if fresh else None)
                    keys.append(_signed(np.concatenate([np.zeros(0, _U), *(x for x, _ in piece_keys(hashes, rule))])) if fresh else np.zeros(0, np.int64))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(sketches, pa.binary()), lists, part.column(2)], schema=schema)

    return run


def _finer(rule: Rule):
    """Rows (keys, node, spare) of a finer sketch of each text, by band; all its pieces."""
    schema = pa.schema([("keys", pa.list_(pa.int64())), ("node", pa.int64()), ("spare", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                found = []
                for text in batch.slice(k, 200).column(0):
                    hashes = shingles(text.as_py(), rule.words)
                    if len(hashes):
                        node = fingerprint(hashes, rule.seed)[0]
                        found += [(_signed(keys), node, spare) for keys, spare in piece_keys(hashes, rule, pieces_each=FINE, whole=True)]
                if found:
                    ends = np.concatenate(([0], np.cumsum([len(f[0]) for f in found])))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([f[0] for f in found])))
                    yield pa.RecordBatch.from_arrays([lists, *(pa.array([f[c] for f in found], pa.int64()) for c in (1, 2))], schema=schema)

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, hub, ...) of all nodes of a key but its first, the hub, from
    rows (key, node, ...) sorted by both, of which some repeat. A key of any size streams by."""
    last_key = last_node = last_hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = (np.asarray(batch.column(k)) for k in (0, 1))
        goes_on = last_key is not None and keys[0] == last_key
        new_key = np.append(not goes_on, keys[1:] != keys[:-1])
        new_node = new_key | np.append(not (goes_on and nodes[0] == last_node), nodes[1:] != nodes[:-1])
        starts = np.flatnonzero(new_key)
        first = nodes[starts]
        if goes_on:
            starts, first = np.append(0, starts), np.append(last_hub, first)
        hubs = np.repeat(first, np.diff(np.append(starts, len(keys))))
        keep = np.flatnonzero(new_node & (nodes != hubs))
        last_key, last_node, last_hub = keys[-1], nodes[-1], hubs[-1]
        rest = [batch.column(k).take(pa.array(keep)) for k in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (keys, nodes, hubs)), *rest], names=["key", "node", "hub", *batch.schema.names[2:]])


def _may_link(rule: Rule):
    """Pairs whose sizes and parity sketches let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, un, vn = (np.asarray(batch.column(k)) for k in (0, 1, 2, 3))
            keep = rule.den * np.minimum(un, vn) >= rule.num * np.maximum(un, vn)
            most = rule.most_apart(un, vn)
            for k in np.flatnonzero(keep):
                two = _fold([batch.column(4)[k].as_py(), batch.column(5)[k].as_py()])
                keep[k] = np.bitwise_count(two[0] ^ two[1]).sum(dtype=np.int64) <= most[k]
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return run


def _sets(rule: Rule):
    schema = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                sets = [s for s in (shingles(t.as_py(), rule.words) for t in batch.slice(k, 200).column(0)) if len(s)]
                if sets:
                    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(np.concatenate(sets))))
                    nodes = [fingerprint(s, rule.seed)[0] for s in sets]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists], schema=schema)

    return run


def _block(rule: Rule, tries: int, nodes, roots, sizes, asks, sketches: list[bytes], failed: list) -> set[tuple[int, int]]:
    """Pairs within one block of a key that may link: for each node that asks, the
    ``tries`` nearest untested ones of each other component, and of four such
    components at most. Others wait for the next turn, when more are in one component."""
    if len(set(roots)) < 2:
        return set()
    words, out = _fold(sketches), set()
    for i in np.flatnonzero(asks):
        fits = (rule.den * np.minimum(sizes, sizes[i]) >= rule.num * np.maximum(sizes, sizes[i])) & (roots != roots[i])
        if failed[i] is not None:
            fits &= ~np.isin(nodes, failed[i])
        if fits.any():
            at = np.flatnonzero(fits)
            apart = np.bitwise_count(words[at] ^ words[i]).sum(1, dtype=np.int64)
            near = apart <= rule.most_apart(sizes[at], sizes[i])
            at = at[near][np.argsort(apart[near], kind="stable")]
            by_root = np.argsort(roots[at], kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(roots[at][by_root]) != 0)) if len(at) else np.zeros(0, np.int64)
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            for j in at[np.sort(by_root[rank < tries])][: 4 * tries]:
                out.add((int(max(nodes[i], nodes[j])), int(min(nodes[i], nodes[j]))))
    return out


def _near(rule: Rule, tries: int):
    """:func:`_block` over rows that come sorted by block, one block in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            nodes, roots, sizes, asks = (rows[c].to_numpy() for c in ("node", "root", "n", "asks"))
            sketches, failed, out = rows["sketch"].tolist(), [None if x is None else np.asarray(x) for x in rows["failed"]], []
            keys = rows["key"].to_numpy()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out += [(int(keys[a]), u, v) for u, v in _block(rule, tries, nodes[a:b], roots[a:b], sizes[a:b], asks[a:b], sketches[a:b], failed[a:b])]
            return pd.DataFrame(out, columns=["key", "u", "v"], dtype="int64")

        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            of = rows[["key", "i", "j"]].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1))
            yield blocks(rows.iloc[: cuts[-1]], cuts)
            rest = rows.iloc[cuts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield blocks(rest, np.array([0, len(rest)]))

    return run


class _Search:
    """What the turns of :func:`similar` share: the documents' nodes, their
    sketches, and the pairs and components found so far."""

    def __init__(self, texts: DataFrame, rule: Rule, scratch: Scratch, broadcast_rows: int, block: int):
        self.texts, self.rule, self.scratch, self.broadcast_rows, self.block = texts, rule, scratch, broadcast_rows, block
        self.turn = 0
        self.nodes = self.sketches = self.tested = self.roots = None

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= self.broadcast_rows else df

    def texts_of(self, nodes: DataFrame, tag: str) -> DataFrame:
        """Texts of one document of each node of ``nodes`` (node)."""
        wanted = self.nodes.join(self.small(nodes), "node", "left_semi").select(_or_least(F.col("least_id")).alias("wanted")).distinct()
        wanted = self.scratch.write(wanted, f"wanted-{tag}")
        return self.texts.join(self.small(wanted), _or_least(F.col("doc_id")) == F.col("wanted"), "left_semi").select("text")

    def test(self, pairs: DataFrame) -> None:
        """Find out which of the pairs (u, v) link, and with that the components.

        The sets themselves decide, made anew from one document of each node concerned."""
        self.turn += 1
        turn, scratch, rule = self.turn, self.scratch, self.rule
        ends = scratch.write(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), f"ends-{turn}")
        sets = scratch.write(self.texts_of(ends, f"{turn}").mapInArrow(_sets(rule), "node long, members array<long>"), f"sets-{turn}")
        sets = sets.dropDuplicates(["node"])  # an id can occur in several rows
        left, right = (sets.select(F.col("node").alias(c), F.col("members").alias(f"{c}_set")) for c in "uv")
        both = pairs.join(left, "u").join(right, "v")
        shared = F.size(F.array_intersect("u_set", "v_set"))
        both = both.select("u", "v", (rule.den * shared >= rule.num * (F.size("u_set") + F.size("v_set") - shared)).alias("link"))
        new = scratch.write(both, f"tested-{turn}")
        scratch.drop(f"ends-{turn}", f"wanted-{turn}", f"sets-{turn}")
        links = new.where("link").select("u", "v")
        if self.tested is not None:
            self.tested = self.tested.unionByName(new)
            if links.isEmpty():
                return
            links = links.unionByName(self.roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        else:
            self.tested = new
        self.roots = scratch.write(connected_components(links, scratch), f"roots-{turn}")
        scratch.drop(*(f"roots-{k}" for k in range(turn)))

    def test_hubs(self, met: DataFrame, tag: str) -> None:
        """Test all (node, hub) of ``met`` whose sizes and sketches let them link."""
        pairs = met.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
        for c in "uv":
            pairs = pairs.join(self.sketches.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")), c)
        pairs = pairs.select("u", "v", "u_n", "v_n", "u_sketch", "v_sketch").mapInArrow(_may_link(self.rule), "u long, v long")
        self.test(self.scratch.write(pairs, f"pairs-{tag}"))

    def open(self, met: DataFrame, tag: str, among: DataFrame | None = None) -> DataFrame:
        """``met`` (key, node, ...) with each node's ``root``, without the keys whose
        nodes are all in one component, or that are not in ``among`` (key), if given; of keys with the same nodes one, with the
        root of its largest part (``main``), how many nodes it has and how many
        ``outside`` that part, and how many such keys there are (``times``)."""
        now = met.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        keys = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("main.size < size")
        if among is not None:
            keys = keys.join(self.small(among), "key", "left_semi")
        keys = keys.groupBy("size", "x", "y", F.col("key").bitwiseAND(F.lit(1))).agg(F.min(F.struct("key", "main")).alias("one"), F.count(F.lit(1)).alias("times"))
        keys = keys.select("one.key", F.col("one.main.root").alias("main"), "size", (F.col("size") - F.col("one.main.size")).alias("outside"), "times")
        out = self.scratch.write(now.join(self.small(self.scratch.write(keys, f"keys-{tag}")), "key"), tag)
        self.scratch.drop(f"keys-{tag}")
        return out

    def settle(self, now: DataFrame, tag: str) -> None:
        """Compare the nodes of each key, given as by :meth:`open`, until none in
        different components may link any more."""
        for k in count():
            asked = self.scratch.write(self.asked(now, 16 ** min(k, 2)), f"asked-{tag}-{k}")
            if asked.isEmpty():
                self.scratch.drop(f"met-{tag}-{k}", f"asked-{tag}-{k}")
                return
            self.test(asked.select("u", "v").distinct())
            # A key that asks nothing has no pair left that may link: components only grow.
            now = self.open(now.select("key", "node"), f"met-{tag}-{k + 1}", asked.select("key").distinct())
            self.scratch.drop(f"met-{tag}-{k}", f"asked-{tag}-{k}")

    def asked(self, now: DataFrame, tries: int) -> DataFrame:
        """(key, u, v): nodes of one key, in different components, that may link and
        were not tested, from rows of :meth:`open`; see :func:`_block`."""
        now = now.select("key", "node", "root", (F.col("root") != F.col("main")).alias("asks"), F.ceil(F.col("outside") / self.block).cast("int").alias("askers"), F.ceil(F.col("size") / self.block).cast("int").alias("others"))
        slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        # Each node outside the key's main component goes to all blocks of nodes, and each node to all blocks of those.
        asking = now.where("asks").select("key", "node", "root", "asks", slot("askers").alias("i"), F.explode(every("others")).alias("j"))
        asked = now.select("key", "node", "root", F.lit(False).alias("asks"), F.explode(every("askers")).alias("i"), slot("others").alias("j"))
        failed = self.tested.where("NOT link")
        failed = failed.unionByName(failed.select(F.col("v").alias("u"), F.col("u").alias("v"), "link")).groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("failed"))
        rows = asking.join(failed, "node", "left").unionByName(asked.withColumn("failed", F.lit(None).cast("array<long>")))
        rows = rows.join(self.sketches, "node")
        rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("asks"), "node")
        return rows.select("key", "i", "j", "node", "root", "n", "asks", "sketch", "failed").mapInPandas(_near(self.rule, tries), "key long, u long, v long")

    def among_hot(self, hot: DataFrame, hot_nodes: int) -> None:
        """Settle the nodes of hot keys, given as (node), by finer pieces.

        Each gives all its pieces now. One that has more pieces in keys that are
        not hot than may differ, and one, meets there whatever it can link with,
        so hot keys count only between the others."""
        found = self.texts_of(hot, "hot").mapInArrow(_finer(self.rule), "keys array<long>, node long, spare long")
        held = found.select(F.explode("keys").alias("key"), "node", "spare").repartition("key", "node").dropDuplicates(["key", "node"])
        met = self.scratch.write(held.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meeting, "key long, node long, hub long, spare long"), "fine-met")
        self.test_hubs(met, "fine")
        now = self.open(met, "fine-open")
        self.settle(now.where(F.col("outside") <= hot_nodes), "cool")
        now = now.where(F.col("outside") > hot_nodes).withColumn("odd", F.col("key").bitwiseAND(F.lit(1)))
        poor = now.groupBy("node", "odd").agg(F.sum("times").alias("n_hot"), F.max("spare").alias("spare")).where("n_hot > spare").select("node", "odd")
        self.settle(self.open(now.join(poor, ["node", "odd"], "left_semi").select("key", "node"), "met-hot-0"), "hot")


def similar(
    docs: DataFrame,
    *,
    percent: int = 90,
    words: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = 1_000_000,
    block: int = 4096,
    hot_nodes: int = 1024,
) -> DataFrame:
    """doc_id, n_shingles and component_id of each document.

    Two documents link when 100 * intersection >= percent * union of their sets
    of shingles. ``component_id`` is the smallest id that links lead to.

    1. One pass over the texts gives each document its set's size, fingerprint,
       parity sketch and piece keys. Documents of one fingerprint are one node from
       here on, and copies that one task reads give their keys once.
    2. Rows of a key stream by in order. Each node of a key that several hold is
       paired with the key's first: as many pairs as rows, however hot the key.
    3. Pairs that sizes and sketches let pass are verified by the sets.
    4. Where other nodes of a key are still in different components, those outside
       the largest one are compared with all of the key's, in blocks, by parity
       sketches. What may link is verified; this is repeated until nothing new
       may link, so no link between components is lost.
    5. A key is hot if more than ``hot_nodes`` of its nodes are outside its largest
       component, and its nodes meet by finer pieces instead: a passage that many
       share makes some pieces hot, but a node whose other pieces are enough to
       meet all that it can link with needs no hot one. Only what consists of
       little else is compared within hot keys.

    ``percent`` is 1 to 100. Null or empty texts and those without words have
    empty sets, link with nothing and are their own component. Texts of fewer
    words than ``words`` are one shingle. Repeated rows are copies. A null id
    takes the smallest id of its component, null if there is none. Other columns
    are ignored. Broadcasts are of at most ``broadcast_rows`` numbers; beyond
    that the same joins shuffle.
    """
    found = _similar(docs, Rule(percent, 100, words), id_col, text_col, broadcast_rows, block, hot_nodes, hashed=False)
    return found.select("doc_id", "n_shingles", "component_id")


def _similar(docs: DataFrame, rule: Rule, id_col: str, text_col: str, broadcast_rows: int, block: int, hot_nodes: int, hashed: bool) -> DataFrame:
    """The rows of :func:`similar`, with the hash of each row's text if ``hashed`` (else null)."""
    if not 1 <= rule.num <= rule.den:
        raise ValueError("percent must be 1 to 100")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.withColumn("text_hash", text_hash(F.col("text")) if hashed else F.lit(None).cast("long"))
    with Scratch(docs.sparkSession) as scratch:
        keyed, nodes = _fingerprinted(rows, rule, scratch)
        while nodes.where("other <> last").count():  # two sets of one number: give all others
            scratch.drop("keyed", "nodes")
            rule = replace(rule, seed=rule.seed + 1)
            keyed, nodes = _fingerprinted(rows, rule, scratch)
        search = _Search(texts, rule, scratch, broadcast_rows, block)
        search.nodes = nodes
        held = keyed.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
        met = scratch.write(held.mapInArrow(_meeting, "key long, node long, hub long"), "met")
        kept = scratch.keep(keyed.select("doc_id", "n_shingles", "node", "text_hash"), "docs")
        concerned = met.select(F.explode(F.array("node", "hub")).alias("node")).distinct()
        sketches = keyed.where("sketch IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "sketch").join(search.small(scratch.write(concerned, "concerned")), "node", "left_semi")
        search.sketches = scratch.write(sketches.dropDuplicates(["node"]), "sketches")
        scratch.drop("keyed", "concerned")

        search.test_hubs(met, "first")
        now = search.open(met, "met-all-0")
        scratch.drop("met")
        hot = F.col("outside") > hot_nodes
        later = scratch.write(now.where(hot).select("key", "node"), "met-hot")
        search.settle(now.where(~hot), "all")
        hot = scratch.write(search.open(later, "met-later").select("node").distinct(), "hot")
        if not hot.isEmpty():
            search.among_hot(hot, hot_nodes)

        # Only nodes with copies or links can have another id than their own.
        many = nodes.join(search.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = scratch.write(many.groupBy("root").agg(F.min("least_id").alias("component"), F.sum("copies").alias("docs")).where("docs > 1"), "least")
        named = scratch.keep(many.join(search.small(least), "root").select("node", "component"), "named")
        named = search.small(named)
    out = kept.join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "text_hash")


def _fingerprinted(rows: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each row's set, sketch and keys, and the distinct sets."""
    keyed = scratch.write(rows.mapInArrow(_keyed(rule), KEYED), "keyed")
    nodes = keyed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("other").alias("other"), F.max("other").alias("last"))
    return keyed, scratch.write(nodes, "nodes")


def _or_least(doc_id: Column) -> Column:
    """The id, or for null a number in its place."""
    return F.coalesce(doc_id, F.lit(-(2**63)))


def keep_one(docs: DataFrame, *, percent: int = 90, words: int = 3, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, block: int = 4096, hot_nodes: int = 1024) -> DataFrame:
    """``docs`` with one document of each component: the one whose id is the smallest.

    All columns are kept. Documents without words stay. Each row is decided by
    its own id and text: rows of one component that share the kept id stay
    together, an id that is dropped in one component can stay in another, and
    null ids stay only where their component has no other.
    """
    found = _similar(docs, Rule(percent, 100, words), id_col, text_col, broadcast_rows, block, hot_nodes, hashed=True)
    dropped = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "text_hash")
    return without(docs, dropped, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows)
