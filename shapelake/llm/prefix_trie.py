"""A trie of conversation prefixes, screened by a count-min sketch.

A prefix of a conversation is its first d turns. Prefixes that several
conversations share are nodes that must be grouped exactly; most prefixes are one
conversation's own. A count-min sketch never estimates too low, so an estimate of
one proves that a prefix, and all that continue it, have one conversation: those
nodes are known without a shuffle. Only the others are grouped by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

_U = np.uint64
#: Rows of the sketch, its largest width, and cells in a piece of it that tasks pass on.
ROWS, WIDEST, PIECE = 3, 1 << 26, 1 << 17
#: What tells rows of one turn apart before their digests do: characters of the text.
HEAD_CHARS = 64


def turns_of(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, digest (of role and text), words and the columns that order a conversation's rows.

    Texts stay behind: a row goes on with 16 bytes for its role and text and the
    first characters of the text. Null roles and texts are empty. Rows without a
    conv_id belong to no conversation and give none.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, HEAD_CHARS).alias("head"), digest.alias("digest"), word_count(text).alias("words"))


def _prefix_rows(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one too:
    conv_id, depth, len (turns in all), x and y (the prefix), px and py (the one
    before it), words (of its last turn)."""
    own = turns.withColumn("block", F.col("conv_id") - F.col("conv_id") % group)
    each = Window.partitionBy("block", "conv_id")
    order = each.orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "head", "digest")))
    own = own.repartition("block").withColumn("at", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(each).cast("int"))
    is_head = (F.col("conv_id") == F.col("block")) & (F.col("at") < heads)
    base = F.collect_list(F.when(is_head, F.struct("at", "digest", "words"))).over(Window.partitionBy("block"))
    own = own.withColumn("base", F.array_sort(base))
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")).withColumn("taken", F.least("h", F.size("base")))
    turn = lambda depth, digest, words: F.struct(depth.cast("int").alias("depth"), digest.alias("digest"), words.cast("long").alias("words"))
    first = F.concat(F.array(turn(F.lit(0), F.lit(None).cast("binary"), F.lit(0))), F.transform(F.slice("base", 1, F.col("taken")), lambda t: turn(t["at"], t["digest"], t["words"])))
    none = F.slice(F.array(turn(F.lit(0), F.col("digest"), F.col("words"))), 1, 0)
    rest = F.array(turn(F.col("taken") + F.col("at") - F.col("h"), F.col("digest"), F.col("words")))
    rebuilt = F.concat(F.when(F.col("at") == 1, first).otherwise(none), F.when(F.col("at") > F.col("h"), rest).otherwise(none))
    rows = own.select("block", "conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), F.explode(rebuilt).alias("t")).select("block", "conv_id", "len", "t.*")
    so_far = Window.partitionBy("block", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    for name, seed in (("x", 1), ("y", 2)):
        # A prefix stands for its set of (place, turn): the exclusive or of their numbers.
        term = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64("digest", "depth", F.lit(seed)))
        rows = rows.withColumn(f"{name}_own", term).withColumn(name, F.bit_xor(f"{name}_own").over(so_far))
    return rows.select("conv_id", "depth", "len", "x", "y", F.col("x").bitwiseXOR(F.col("x_own")).alias("px"), F.col("y").bitwiseXOR(F.col("y_own")).alias("py"), "words")


def _cells(x: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cell of each digest in one row of the sketch; width is a power of two."""
    with np.errstate(over="ignore"):
        z = (x.astype(np.int64).view(_U) ^ _U(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) * _U(0xBF58476D1CE4E5B9)
        z ^= z >> _U(29)
        z *= _U(0x94D049BB133111EB)
        return ((z >> _U(32)) & _U(width - 1)).astype(np.int64)


SKETCH = "piece int, once binary, more binary"


def _sketched(width: int):
    """Pieces of the sketch of a task's prefixes. A cell holds none, one or more:
    two bitmaps. Cells are met in batches; those met twice in one count as more."""
    schema = pa.schema([("piece", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
    size = min(PIECE, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more, seen = np.zeros(ROWS * width // 8, np.uint8), np.zeros(ROWS * width // 8, np.uint8), False
        for batch in batches:
            x, seen = np.asarray(batch.column(0)), True
            for row in range(ROWS):
                cells, times = np.unique(_cells(x, row, width), return_counts=True)
                at, bit = (cells + row * width) >> 3, (1 << (cells & 7)).astype(np.uint8)
                again = (times > 1) | (once[at] & bit > 0)
                np.bitwise_or.at(more, at[again], bit[again])
                np.bitwise_or.at(once, at, bit)
        if seen:
            for k in range(ROWS * width // size):
                part = slice(k * size // 8, (k + 1) * size // 8)
                if once[part].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once[part].tobytes()], pa.binary()), pa.array([more[part].tobytes()], pa.binary())], schema=schema)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one number, which come one after another, added up."""
    held = None
    row = lambda k, a, b: pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["piece", "once", "more"])
    for batch in batches:
        for k, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if held and held[0] == k:
                held = k, held[1] | a, held[2] | b | (held[1] & a)
            else:
                if held:
                    yield row(*held)
                held = k, a, b
    if held:
        yield row(*held)


def _screen(sketch, width: int):
    """Rows with ``shared``: the estimate of the prefix is over one; ``parent_shared`` likewise."""

    def over_one(x: np.ndarray) -> np.ndarray:
        more, out = sketch.value, np.ones(len(x), bool)
        for row in range(ROWS):
            cells = _cells(x, row, width) + row * width
            out &= (more[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, x, px = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("depth", "x", "px"))
            own, before = (depth == 0) | over_one(x), (depth <= 1) | over_one(px)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(before)], names=[*batch.schema.names, "shared", "parent_shared"])

    return run


def _joined_ids(batches: Iterator[pa.RecordBatch], most: int = 8192) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``most`` ids of one prefix, comma-joined, from rows (x, y, conv_id) in order."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        x, y, ids = (np.asarray(batch.column(c)) for c in range(3))
        cuts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else []
        starts = [s for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True) for s in range(a, b, most)]
        rows = [(int(x[a]), int(y[a]), int(ids[a]), ",".join(map(str, ids[a:b].tolist()))) for a, b in zip(starts, [*starts[1:], len(x)], strict=False)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each prefix's ids, from rows of :func:`_joined_ids` in order."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    row = lambda key, sha: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sha.hexdigest()])], schema=schema)
    last, sha = None, None
    for batch in batches:
        for x, y, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
            if (x, y) == last:
                sha.update(b"," + ids.encode())
            else:
                if last is not None:
                    yield row(last, sha)
                last, sha = (x, y), hashlib.sha256(ids.encode())
    if last is not None:
        yield row(last, sha)


def _sketch(spark, prefixes: DataFrame, width: int):
    """The bitmap of cells that several prefixes met, at the tasks: ROWS * width bits."""
    pieces = prefixes.where("depth > 0").select("x").mapInArrow(_sketched(width), SKETCH)
    whole = np.zeros(ROWS * width // 8, np.uint8)
    size = min(PIECE, width) // 8
    for r in pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(_merged, SKETCH).select("piece", "more").toLocalIterator():
        whole[r.piece * size : (r.piece + 1) * size] = np.frombuffer(r.more, np.uint8)
    return spark.sparkContext.broadcast(whole)


def prefix_trie(conversations: DataFrame, *, group: int = 20, heads: int = 4, widest: int = WIDEST, **columns: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    Conversation c is rebuilt from the first h turns of conversation
    c - c % ``group`` and its own after its first h, where h is the crc32 of its
    decimal id modulo ``heads``; with ``heads`` 1, every conversation is as it is.

    Returns conv_id (smallest member), depth, parent_conv_id (the parent's
    conv_id, null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, as the contract of ``op13`` says.

    1. A row's role and text become 16 bytes; only those, the head of the text and
       the word count are shuffled, once, by group of conversations. Running
       exclusive ors of numbers of (place, turn) give each prefix 128 bits.
    2. Each task sketches its prefixes: three rows of at most ``widest`` two-bit
       cells, at least four for each prefix up to that; pieces are merged by a
       shuffle, and at most 24 MB go to the tasks.
    3. A prefix with an estimate of one is its conversation's alone: its node is
       made in place. With more prefixes than the sketch can tell apart, more of
       them are grouped; the result is the same.
    4. The others are grouped by digest, counts first within tasks. A node's
       smallest member stands for it: along that conversation, sums from the end
       carry leaves and saved tokens to the nodes above, and a second grouping
       adds up what the members bring.
    5. Parents with over a ten-thousandth of all grouped prefixes, so under 10 000,
       are broadcast to their children; the others are joined by a shuffle.
    6. Ids of the conversations that end at a node are sorted over all tasks,
       joined in runs, and the runs hashed in order.

    Rows of one turn are ordered by role, the first 64 characters of the text, and
    its digest; repeated rows are turns of their own. Null turns come first. Rows
    without a conv_id are left out. Empty tables give no rows. Columns are named
    by ``id_col``, ``turn_col``, ``role_col`` and ``text_col``; others are ignored.
    """
    spark = conversations.sparkSession
    with Scratch(spark) as scratch:
        prefixes = scratch.write(_prefix_rows(turns_of(conversations, **columns), group, heads), "prefixes")
        n = prefixes.count()
        width = min(widest, max(1 << 10, 1 << (4 * n).bit_length()))
        sketch = _sketch(spark, prefixes, width)
        schema = "conv_id long, depth int, len int, x long, y long, px long, py long, words long, shared boolean, parent_shared boolean"
        rows = scratch.write(prefixes.select("conv_id", "depth", "len", "x", "y", "px", "py", "words").mapInArrow(_screen(sketch, width), schema), "screened")
        grouped, alone = rows.where("shared").drop("shared"), rows.where("NOT shared")
        nodes = grouped.groupBy("x", "y").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), (F.max("len") > F.max("depth")).alias("goes_on"), *(F.max(c).alias(c) for c in ("depth", "px", "py", "words", "parent_shared")))
        nodes = scratch.write(nodes, "nodes")

        # What each conversation brings to its grouped prefixes.
        of = nodes.select("conv_id", "depth", "n_convs", "goes_on", F.lit(True).alias("stands"))
        mine = grouped.join(of, ["conv_id", "depth"], "left").select("conv_id", "depth", "x", "y", "px", "py", F.coalesce("stands", F.lit(False)).alias("stands"), F.when(F.col("stands"), (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"), F.when(F.col("stands") & ~F.col("goes_on"), 1).otherwise(0).alias("leaf"))
        ends_alone = alone.where("depth = len").select("conv_id", "depth", *(F.lit(None).cast("long").alias(c) for c in ("x", "y", "px", "py")), F.lit(False).alias("stands"), F.lit(0).cast("long").alias("saved"), F.lit(1).alias("leaf"))
        to_end = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        mine = mine.unionByName(ends_alone).select("x", "y", "px", "py", "depth", "stands", F.sum("saved").over(to_end).alias("saved"), F.max("leaf").over(to_end).alias("leaf")).where("x IS NOT NULL")
        up = F.array(F.struct("x", "y", "saved", F.col("leaf").cast("long").alias("leaf"), F.lit(0).cast("long").alias("child")), F.struct(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"), F.lit(1).cast("long").alias("child")))
        brought = mine.select(F.explode(F.slice(up, 1, F.when(F.col("stands") & (F.col("depth") > 0), 2).otherwise(1))).alias("b")).select("b.*")
        heads_alone = alone.where("parent_shared")
        brought = brought.unionByName(heads_alone.select(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"), F.lit(1).cast("long").alias("child")))
        sums = brought.groupBy("x", "y").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"))

        ends = grouped.where("depth = len").select("x", "y", "conv_id")
        ends = ends.repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id").mapInArrow(_joined_ids, "x long, y long, first long, ids string")
        ends = ends.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(_hashed_ids, "x long, y long, ends_sha256 string")
        empty = F.sha2(F.lit("").cast("binary"), 256)
        whole = nodes.join(sums, ["x", "y"], "left").join(ends, ["x", "y"], "left").select("conv_id", "depth", "px", "py", (F.col("parent_shared") & (F.col("depth") > 0)).alias("parent_shared"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
        single = alone.select("conv_id", "depth", "px", "py", "parent_shared", F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256"))
        out = scratch.keep(_with_parents(whole, single, nodes, max(1000, n // 10_000)), "trie")
    sketch.unpersist()
    return out


def _with_parents(whole: DataFrame, single: DataFrame, nodes: DataFrame, many: int) -> DataFrame:
    """All nodes with ``parent_conv_id``. A parent that was not grouped is its child's
    conversation's own; of the others, those with over ``many`` members are broadcast."""
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("found"), "n_convs")
    big, rest = (parents.where(c).drop("n_convs") for c in (F.col("n_convs") > many, F.col("n_convs") <= many))
    asked = whole.where("parent_shared").unionByName(single.where("parent_shared"))
    near = asked.join(F.broadcast(big), ["px", "py"], "left")
    far = near.where("found IS NULL").drop("found").join(rest, ["px", "py"], "left")
    out = near.where("found IS NOT NULL").unionByName(far)
    own = whole.unionByName(single).where("NOT parent_shared").withColumn("found", F.when(F.col("depth") > 0, F.col("conv_id")))
    number = lambda c: F.col(c).cast("long").alias(c)
    return out.unionByName(own).select(number("conv_id"), number("depth"), F.col("found").alias("parent_conv_id"), *(number(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), "ends_sha256")
