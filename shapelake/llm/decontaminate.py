"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_hash, without

#: Tokens are runs of letters, marks and digits, in lower case.
NOT_TOKEN = r"[^\p{L}\p{M}\p{N}]+"


def token_hashes(text: Column) -> Column:
    tokens = F.filter(F.split(F.lower(text), NOT_TOKEN), lambda w: w != "")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _masks(blocks: int, max_subs: int) -> list[tuple[int, ...]]:
    """Blocks of a window that a mask looks at: all choices of as many as ``max_subs`` changed tokens leave whole."""
    return list(combinations(range(blocks), blocks - max_subs))


def _windows(rows: DataFrame, at: str, span: int, blocks: int) -> DataFrame:
    """A row for each window of ``span`` tokens of ``tokens``, with one hash for each block."""
    starts = F.when(F.size("tokens") >= span, F.sequence(F.lit(0), F.size("tokens") - span))
    rows = rows.withColumn(at, F.explode(starts))
    wide = span // blocks
    for b in range(blocks):
        rows = rows.withColumn(f"{at}_{b}", F.xxhash64(*(F.get("tokens", F.col(at) + (b * wide + k)) for k in range(wide))))
    return rows


def _seeds(at: str, masks: list[tuple[int, ...]]) -> Column:
    """For each mask its number and the hash of the blocks it looks at."""
    return F.inline(F.array(*(F.struct(F.lit(m).alias(f"{at}_mask"), F.xxhash64(F.lit(m), *(F.col(f"{at}_{b}") for b in kept)).alias(f"{at}_seed")) for m, kept in enumerate(masks))))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    span: int = 12,
    blocks: int = 4,
    max_subs: int = 2,
    broadcast_rows: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents that share a window of ``span`` tokens with a benchmark item, at
    most ``max_subs`` of them substituted.

    A window is cut into ``blocks`` blocks. Each mask ignores ``max_subs`` of
    them, and every choice is a mask, so however the substitutions fall one mask
    ignores them all: no such window is missed. Seeds (hashes of the tokens that
    a mask looks at) of the benchmark go to all tasks if they are at most
    ``broadcast_rows``; documents are not shuffled then, only the few windows that
    hold. Of a larger benchmark a bitmap of fixed size goes to all tasks, one bit
    for each value of its seeds modulo 2^28 (32 MB), and the windows whose bit is
    set are joined with the seeds by a shuffle. At a hit all tokens of both
    windows are compared, those that the mask ignored too. Tokens are compared by
    64-bit hashes.

    Returns doc_id, item_id, n_windows (pairs of windows that hold), first_token
    and end_token (where those lie in the document) and fewest_subs.

    Null or empty texts, and texts and items of under ``span`` tokens, have no
    windows and give no row. Rows of one doc_id (null is one) or one item_id
    count together. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), token_hashes(F.col(text_col)).alias("tokens"))
    held = _held(rows, benchmark, span, blocks, max_subs, broadcast_rows, item_col, item_text_col)
    return held.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.min("p").alias("first_token"), (F.max("p") + span).alias("end_token"), F.min("subs").alias("fewest_subs"))


def _held(rows: DataFrame, benchmark: DataFrame, span: int, blocks: int, max_subs: int, broadcast_rows: int, item_col: str, item_text_col: str) -> DataFrame:
    """Pairs of windows that hold, with every column of ``rows`` but its ``tokens``."""
    named = [c for c in rows.columns if c != "tokens"]
    if span % blocks or not 0 <= max_subs < blocks:
        raise ValueError("span must be a multiple of blocks, and max_subs less than blocks")
    masks = _masks(blocks, max_subs)
    items = benchmark.select(F.col(item_col).alias("item_id"), token_hashes(F.col(item_text_col)).alias("tokens"))
    seeds = _windows(items, "q", span, blocks).withColumn("window", F.slice("tokens", F.col("q") + 1, span))
    few = seeds.count() * len(masks) <= broadcast_rows
    seeds = seeds.select("item_id", "window", *(f"q_{b}" for b in range(blocks)), _seeds("q", masks))
    rows = _windows(rows, "p", span, blocks)
    rows = rows.select(*named, "tokens", "p", *(f"p_{b}" for b in range(blocks)), _seeds("p", masks))
    first = F.lit(None).cast("int")
    for m, kept in reversed(list(enumerate(masks))):
        same = F.lit(True)
        for b in kept:
            same &= F.col(f"p_{b}") == F.col(f"q_{b}")
        first = F.when(same, F.lit(m)).otherwise(first)
    if few:
        seeds = F.broadcast(seeds)
    else:
        rows = _with_seed_in(rows, seeds).withColumn("window", F.slice("tokens", F.col("p") + 1, span)).drop("tokens")
        seeds = seeds.withColumnRenamed("window", "item_window")
    hits = rows.join(seeds, F.col("p_seed") == F.col("q_seed"))
    # Several masks can find one pair of windows; the first of them counts it.
    hits = hits.where((F.col("p_mask") == first) & (F.col("q_mask") == first))
    if few:
        # Spelled out, not a higher-order function: those would end code generation here,
        # and every window would then carry a copy of its document's tokens to the join.
        subs = sum((F.when(F.get("tokens", F.col("p") + k) == F.get("window", F.lit(k)), 0).otherwise(1) for k in range(span)), F.lit(0))
    else:
        subs = sum((F.when(F.get("window", F.lit(k)) == F.get("item_window", F.lit(k)), 0).otherwise(1) for k in range(span)), F.lit(0))
    return hits.select(*named, "item_id", "p", subs.alias("subs")).where(F.col("subs") <= max_subs)


#: Bits of the bitmap of seeds.
BITMAP = 1 << 28


def _with_seed_in(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """``rows`` whose ``p_seed`` has its bit set in a bitmap of all ``q_seed``; some
    of the others stay too, none of those that are among the seeds goes."""
    place = lambda seed: F.pmod(seed, F.lit(BITMAP)) + 1
    bits = seeds.select(place(F.col("q_seed")).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    rows = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(F.col("p_seed"))) == F.col("bucket"))
    at = F.bitmap_bit_position(place(F.col("p_seed")))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(`__byte`, `__shift`) & 1") == 1
    return rows.withColumn("__byte", byte).withColumn("__shift", F.pmod(at, F.lit(8)).cast("int")).where(is_set).drop("bucket", "bits", "__byte", "__shift")


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    span: int = 12,
    blocks: int = 4,
    max_subs: int = 2,
    broadcast_rows: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """``docs`` without the documents that :func:`overlaps` finds; all columns are kept.

    Each row is decided by its own text: others that share its id, or have none
    either, stay if they hold no window of the benchmark.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), token_hashes(F.col(text_col)).alias("tokens"))
    held = _held(rows, benchmark, span, blocks, max_subs, broadcast_rows, item_col, item_text_col)
    return without(docs, held, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_ids)
