"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of a turn, and the byte-level vocabulary that texts are encoded with.
START, END = "<|im_start|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

FORMATTED = "conv_id long, n_turns long, formatted string, turn_start array<long>, turn_end array<long>, turn_loss array<boolean>, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    """``text`` without ``<|``: backslashes are doubled and ``<|`` becomes ``<\\|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def escape_role(role: str) -> str:
    """As :func:`escape`, and on one line."""
    return escape(role).replace("\n", "\\n")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """Whole conversation, and where each turn's escaped text starts and ends."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        starts.append(at + len(head))
        ends.append(starts[-1] + len(body))
        parts += [head, body, END, "\n"]
        at = ends[-1] + len(END) + 1
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation: the inverse of :func:`render`."""
    turns = []
    for block in formatted.split(START)[1:]:
        head, _, rest = block.partition("\n")
        turns.append((unescape(head), unescape(rest[: rest.rindex(END)])))
    return turns


def overlapping(starts: np.ndarray, ends: np.ndarray, token_start: np.ndarray, token_end: np.ndarray) -> np.ndarray:
    """Which tokens overlap one of the sorted, disjoint, non-empty spans."""
    if not len(starts):
        return np.zeros(len(token_start), bool)
    first = np.searchsorted(ends, token_start, "right")  # first span that ends after the token starts
    return (first < len(starts)) & (starts[np.minimum(first, len(starts) - 1)] < token_end) & (token_end > token_start)


def masked_text(formatted: str, turn_start, turn_end, turn_loss, token_start: np.ndarray, token_end: np.ndarray, loss_mask: np.ndarray) -> str:
    """Unescaped text under the loss mask, read from the output alone.

    Tokens under the mask are clipped to the turns they overlap, so a token that
    crosses an end of a turn brings nothing from outside. Tokens come in order;
    where they leave no gap in a turn, its text is one slice.
    """
    lo, hi = token_start[loss_mask], token_end[loss_mask]
    out = []
    for a, b, loss in zip(turn_start, turn_end, turn_loss, strict=True):
        if loss and b > a:
            i, j = np.searchsorted(hi, a, "right"), np.searchsorted(lo, b, "left")
            if i == j:
                continue
            reach = np.maximum.accumulate(hi[i:j])
            gaps = np.flatnonzero(lo[i + 1 : j] > reach[:-1])  # between these tokens nothing is under the mask
            starts = [max(int(lo[i]), a), *(int(x) for x in lo[i + 1 : j][gaps])]
            ends = [*(int(x) for x in reach[:-1][gaps]), min(int(reach[-1]), b)]
            out.append(unescape("".join(formatted[s:e] for s, e in zip(starts, ends, strict=True))))
    return "".join(out)


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("turn_start", pa.list_(pa.int64())), ("turn_end", pa.list_(pa.int64())), ("turn_loss", pa.list_(pa.bool_())), ("input_ids", pa.list_(pa.int32())), ("token_start", pa.list_(pa.int32())), ("token_end", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows), kind))


def _formatter(tokenizer: str, loss_roles: tuple[str, ...], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.add_special_tokens([START, END])
        for batch in batches:
            for k in range(0, batch.num_rows, chunk):
                part = batch.slice(k, chunk)
                turns = [[(t["role"], t["text"]) for t in row] for row in part.column(1).to_pylist()]
                rendered = [render(row) for row in turns]
                loss = [np.array([role in loss_roles for role, _ in row], bool) for row in turns]
                ids, lows, highs, masks = [], [], [], []
                for on, (_, starts, ends), enc in zip(loss, rendered, tok.encode_batch([r[0] for r in rendered], add_special_tokens=False), strict=True):
                    spans = np.array([starts, ends], np.int64)[:, on]
                    spans = spans[:, spans[1] > spans[0]]
                    offsets = np.fromiter(chain.from_iterable(enc.offsets), np.int32).reshape(-1, 2)
                    ids.append(np.array(enc.ids, np.int32))
                    lows.append(offsets[:, 0])
                    highs.append(offsets[:, 1])
                    masks.append(overlapping(spans[0], spans[1], lows[-1], highs[-1]))
                starts, ends = ([np.array(r[c], np.int64) for r in rendered] for c in (1, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in turns], pa.int64()), pa.array([r[0] for r in rendered], pa.string()), *(_lists(x, pa.int64()) for x in (starts, ends)), _lists(loss, pa.bool_()), *(_lists(x, pa.int32()) for x in (ids, lows, highs)), _lists(masks, pa.bool_())], schema=_SCHEMA)

    return run


def format_chats(conversations: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",), tokenizer: str = TOKENIZER, chunk: int = 64) -> DataFrame:
    """One row for each conversation: the rendered text, its tokens with their
    character spans, and a loss mask over the tokens.

    Turns are ordered by turn, then role, then text, nulls first. The whole
    conversation is rendered and encoded once with offsets; turn marks are
    tokens of their own. A token is under the mask if its span overlaps the text
    of a turn by one of ``loss_roles``; where a token crosses the end of a text
    (white space beside a mark), :func:`masked_text` clips it to the text.

    A null text or role is empty. Rows of a null ``conv_id`` are one
    conversation. Repeated rows are turns of their own. A conversation is one
    row of the result and must fit in a task, as any text must.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.mapInArrow(_formatter(tokenizer, tuple(loss_roles), chunk), FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    for batch in batches:
        rows = []
        spans = zip(*(batch.column(c).to_pylist() for c in ("turn_start", "turn_end", "turn_loss")), strict=True)
        for k, (formatted, turn) in enumerate(zip(batch.column("formatted").to_pylist(), spans, strict=True)):
            low, high, mask = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("token_start", "token_end", "loss_mask"))
            turns, masked = parse(formatted), masked_text(formatted, *turn, low, high, mask)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(formatted), len(low), int(mask.sum())))
        kinds = [pa.string() if "sha256" in n else pa.int64() for n in names[1:]]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=names)


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of what :func:`format_chats` returned, read back from its output."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
