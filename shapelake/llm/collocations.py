"""Phrases whose words keep company, mined shard by shard (SON, Savasere et al. 1995).

A phrase that occurs ``support`` times in all texts occurs, in one shard at least,
its share of that: a shard with a tenth of all words is mined with a tenth of the
support. The union of what is frequent in some shard therefore misses no phrase,
and one count of those over all texts is exact.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

_U = np.uint64
#: Bits of the map of phrases that are frequent in some shard: 16 MB at every task.
BITS = 1 << 27
#: Bytes of text that a task works on at once, and counts and phrases that it holds.
CHUNK, HELD, NAMED = 1 << 20, 1 << 19, 1 << 19

#: A-Z are lowered, whatever ends a piece becomes a line feed, a tab a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_ODD, _NEXT = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Powers:
    """A number for each byte value, and powers of an odd number and of its inverse."""

    def __init__(self):
        self.of_byte = _mix(np.arange(1, 257, dtype=_U) * _ODD)
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            base = int(_ODD)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, _U), np.full(n, b, _U)))) for b in (base, pow(base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


class Words:
    """Words of a run of whole pieces: where they begin and end in ``data``, the
    piece and the text each is in, and 64 bits that stand for language and word."""

    def __init__(self, data: bytes, base: int, ends: np.ndarray, langs: np.ndarray, powers: _Powers):
        at = np.frombuffer(data, np.uint8)
        line = at == 10
        gap = line | (at == 32)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
        self.data, self.starts, self.ends = data, edge[::2], edge[1::2]
        self.piece = np.cumsum(line)[self.starts] if len(at) else np.zeros(0, np.int64)
        self.text = np.searchsorted(ends, self.starts + base, "right")
        up, down = powers.upto(len(at) + 1)
        with np.errstate(over="ignore"):
            so_far = np.concatenate((np.zeros(1, _U), np.cumsum(powers.of_byte[at] * up[: len(at)])))
            own = (so_far[self.ends] - so_far[self.starts]) * down[self.starts] if len(at) else np.zeros(0, _U)
            self.one = _mix(own ^ _mix(langs[self.text] + (self.ends - self.starts).astype(_U)))

    def longer(self, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the phrases of n words from those of n - 1 words, and which lie within one piece."""
        if len(grams) < 2:
            return np.zeros(0, _U), np.zeros(0, bool)
        with np.errstate(over="ignore"):
            return _mix(grams[:-1] * _NEXT + self.one[n - 1 :]), self.piece[: -(n - 1)] == self.piece[n - 1 :]


def _runs(batch: pa.RecordBatch, powers: _Powers) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """The words of a batch (lang, text, copies), with each text's language and copies, in runs of about ``CHUNK`` bytes cut between pieces."""
    for at in range(0, batch.num_rows, 256):
        yield from _runs_of_few(batch.slice(at, 256), powers)


def _runs_of_few(batch: pa.RecordBatch, powers: _Powers) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    import xxhash

    copies = np.asarray(batch.column(2)).astype(np.int64)
    langs = batch.column(0).to_pylist()
    of_lang = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
    numbers = np.array([of_lang[x] for x in langs], _U)
    texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = (b"\n".join(texts) + b"\n").translate(_PLAIN)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > CHUNK:
            end = data.rfind(b"\n", at, at + CHUNK) + 1 or data.find(b"\n", at + CHUNK) + 1
        yield Words(data[at:end], at, ends, numbers, powers), langs, copies
        at = end


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys & _U(BITS - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _phrases(words: Words, maps: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and places of the phrases of ``n`` words within pieces, both of
    whose parts of n - 1 words are in the map of those (the last of ``maps``)."""
    grams, good = words.one, np.ones(len(words.one), bool)
    for k in range(2, n + 1):
        held = good & _has(maps[k - 2], grams) if len(grams) else good
        grams, whole = words.longer(grams, k)
        good = whole & held[:-1] & held[1:] if len(grams) else whole
    at = np.flatnonzero(good)
    return grams[at], at


class _Counts:
    """Counts by number; few enough to hold, else they are to be given away."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, weights: np.ndarray) -> bool:
        """Take the numbers, each so many times; whether there are now too many to hold."""
        found, of = np.unique(keys, return_inverse=True)
        found = found, np.bincount(of, weights, len(found)).astype(np.int64)  # sums below 2^53 are exact
        self.parts.append(found)
        self.waiting += len(found[0])
        if self.waiting > 2 * HELD:
            self.parts = [self.total()]
            self.waiting = len(self.parts[0][0])
        return self.waiting > HELD

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.zeros(0, _U), *(k for k, _ in self.parts)])
        counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in self.parts)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _shard_counts(n: int, maps: list):
    """Rows (shard, key, times) of the phrases of ``n`` words in a task's part of its
    shards; with a null key, for n = 1, the number of words."""
    schema = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, sizes = _Powers(), {}, {}
        bits = [m.value for m in maps]

        def out(shard: int) -> pa.RecordBatch:
            keys, times = held.pop(shard).total()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shard, np.int32)), pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))], schema=schema)

        for batch in batches:
            of = np.asarray(batch.column(3))
            for shard in np.unique(of).tolist():
                part = batch.filter(pa.array(of == shard)) if (of != shard).any() else batch
                for words, _, copies in _runs(part, powers):
                    times = copies[words.text]
                    sizes[shard] = sizes.get(shard, 0) + int(times.sum())
                    keys, at = _phrases(words, bits, n)
                    if held.setdefault(shard, _Counts()).add(keys, times[at]):
                        yield out(shard)
        for shard in list(held):
            yield out(shard)
        if n == 1:
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int32()), pa.nulls(len(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], schema=schema)

    return run


def _named_counts(longest: int, maps: list):
    """Rows (lang, phrase, times) of all phrases whose bit is set in the map of
    their length; with a null phrase, the number of words of the language."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sizes = _Powers(), {}
        bits = [m.value for m in maps]
        names: dict[int, tuple[str, bytes]] = {}
        counts = _Counts()

        def out() -> pa.RecordBatch:
            keys, times = counts.total()
            rows = [names[k] for k in keys.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].decode() for r in rows], pa.string()), pa.array(times.astype(np.int64))], schema=schema)

        for batch in batches:
            for words, langs, copies in _runs(batch, powers):
                times = copies[words.text]
                for k, n in zip(*np.unique(words.text, return_counts=True), strict=True):
                    sizes[langs[k]] = sizes.get(langs[k], 0) + int(n * copies[k])
                grams, whole = words.one, np.ones(len(words.one), bool)
                for n in range(1, longest + 1):
                    if n > 1:
                        grams, whole = words.longer(grams, n)
                    if not len(grams):
                        break
                    at = np.flatnonzero(whole & _has(bits[n - 1], grams))
                    keys, first = np.unique(grams[at], return_index=True)
                    for key, i in zip(keys.tolist(), at[first].tolist(), strict=True):
                        if key not in names:
                            names[key] = langs[words.text[i]], b" ".join(words.data[words.starts[i] : words.ends[i + n - 1]].split())
                    counts.add(grams[at], times[at])
                if len(names) > NAMED:
                    yield out()
                    names, counts = {}, _Counts()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.nulls(len(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], schema=schema)

    return run


def _bit_map(keys: DataFrame):
    """Bitmap of the numbers (key) modulo ``BITS``, at the tasks."""
    place = F.pmod("key", F.lit(BITS)) + 1
    pieces = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    whole = np.zeros(BITS // 8, np.uint8)
    for r in pieces.toLocalIterator():
        whole[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def frequent_phrases(docs: DataFrame, scratch: Scratch, *, support: int = 100, longest: int = 5, shards: int = 2, words_a_task: int = 20_000_000, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, times) of all phrases of up to ``longest`` words
    that occur ``support`` times in their language, and (lang, n) of all words.

    A shard is a set of splits of the table of texts, named by the hash of file and
    offset. Few shards are better than many: their
    share of the support stays far above chance, and as all tasks share in mining
    them, they need not fit anywhere. All tasks that read a shard mine it
    together, length by length: those of n words whose parts of n - 1 words are
    frequent in some shard are counted by shard. Any shares that sum to 1 keep the
    promise above; a shard's is its part of the words of all languages. All shards
    count by the same maps, so where a phrase's counts sum to less than the support it
    cannot be frequent, and goes at once. What is left of the union over shards is a
    bitmap of 16 MB for each length; the last pass counts all phrases whose bit is set over all texts, by their words, so
    bits that two phrases share cost rows and change nothing. Tasks count in
    bounded tables and pass partial counts on. Nearly every split meets nearly every frequent
    phrase, and a task gives a row for each that it meets: the last pass therefore reads
    many splits in a task, ``words_a_task`` words or less, as long as all cores have two tasks.

    Equal texts of a language are first made one row with its number of copies, so
    that a group of copies is read, mined and counted once.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    shard = F.pmod(F.xxhash64(F.input_file_name(), F.input_file_block_start()), F.lit(shards)).cast("int").alias("shard")
    distinct = docs.select(lang, F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("lang", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = scratch.write(distinct, "distinct").select("lang", "text", "copies", shard)
    maps: list = []
    in_shard = [F.col(f"in_{s}") for s in range(shards)]
    for n in range(1, longest + 1):
        counted = rows.mapInArrow(_shard_counts(n, maps), "shard int, key long, times long")
        counted = counted.groupBy("key").agg(*(F.sum(F.when(F.col("shard") == s, F.col("times")).otherwise(0)).alias(f"in_{s}") for s in range(shards)))
        counted = scratch.write(counted, f"phrases-{n}")
        if n == 1:
            found = counted.where("key IS NULL").first()
            sizes = [0] * shards if found is None else [found[f"in_{s}"] for s in range(shards)]
        # times / support >= size / total, in whole numbers; a shard without words has no share
        least = [-(-support * size // max(1, sum(sizes))) for size in sizes]
        local = functools.reduce(operator.or_, (own >= k for own, k, size in zip(in_shard, least, sizes, strict=True) if size), F.lit(False))
        maps.append(_bit_map(counted.where("key IS NOT NULL").where(local & (sum(in_shard, F.lit(0)) >= support)).select("key")))
        scratch.drop(f"phrases-{n}")
    counting = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // words_a_task))
    named = rows.select("lang", "text", "copies").coalesce(counting).mapInArrow(_named_counts(longest, maps), "lang string, phrase string, times long")
    named = scratch.write(named.groupBy("lang", "phrase").agg(F.sum("times").alias("times")).where(F.col("phrase").isNull() | (F.col("times") >= support)), "named")
    for m in maps:
        m.unpersist()
    return named.where("phrase IS NOT NULL"), named.where("phrase IS NULL").select("lang", F.col("times").alias("n"))


def collocations(docs: DataFrame, *, support: int = 100, longest: int = 5, top: int = 2000, shards: int = 2, broadcast_rows: int = 100_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``top`` phrases by how much oftener their words meet than by chance.

    A-Z are lowered; ``. , ; : ! ?`` and line ends cut a text into pieces, blanks
    and tabs a piece into words; all counts are by language, null being ``und``. A
    candidate has 2 to ``longest`` words and occurs a >= ``support`` times. Cut
    behind its word k it scores floor(1000 a n / (l r)), l and r being the counts
    of its parts and n all words; the lowest cut counts, of equal ones the first.
    Products are decimals of 38 digits, so exact. A candidate that lies in a longer
    one with as many occurrences goes, whether that one stays or not.

    Returns lang, rank, phrase, a, l, r, n and score, ordered by score and a,
    both descending, and the phrase's bytes. Counts come from
    :func:`frequent_phrases`; a phrase is told from others by 64 bits within a
    task and by its words beyond. Languages go to all tasks if they are at most
    ``broadcast_rows``, else they are joined.

    Null and empty texts have no words; repeated rows count each; null ids and
    other columns do not matter; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        phrases, sizes = frequent_phrases(docs, scratch, support=support, longest=longest, shards=shards, lang_col=lang_col, text_col=text_col)
        sizes = F.broadcast(sizes) if sizes.count() <= broadcast_rows else sizes
        parts = F.split("phrase", " ")
        found = phrases.withColumn("w", parts).where(F.size("w") > 1)
        part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
        cuts = found.select("lang", "phrase", F.col("times").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
        for c, name in (("first", "l"), ("rest", "r")):
            cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(c), F.col("times").alias(name)), ["lang", c])
        cuts = cuts.join(sizes, "lang")
        whole = lambda c: F.col(c).cast("decimal(18,0)")
        over = (whole("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
        cuts = cuts.withColumn("over", over.cast("decimal(38,0)")).withColumn("under", (whole("l") * whole("r")).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
        scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("s"))
        scored = scratch.write(scored.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score"), "scored")

        inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " ")))))
        inside = found.where(F.size("w") > 2).select("lang", inner.alias("phrase"), F.col("times").alias("a")).distinct()
        kept = scored.join(inside, ["lang", "phrase", "a"], "left_anti")
        order = [F.desc("score"), F.desc("a"), F.col("phrase")]
        # The best of each part of a language first, so that no task orders a whole language.
        part_of = F.pmod(F.xxhash64("phrase"), F.lit(64))
        best = kept.withColumn("part", part_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return scratch.keep(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
