"""Token counts attributed to sections through token offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's publisher splits text before merging: a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "majority", "split")


def load_encoding(vocabulary: str):
    """The encoding, and the byte length of each of its tokens."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), lengths


def line_bounds(data: bytes) -> np.ndarray:
    """Byte offsets at which lines start, and the end: sections that tile the text.

    A line feed belongs to the line that it ends.
    """
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.unique(np.concatenate(([0], breaks, [len(data)])))


def allocate(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens owned by each section, and how many of a section's tokens cross its start.

    ``token_ends`` are sorted byte offsets, ``bounds`` the k + 1 sorted offsets of
    k sections that tile the text. A token inside one section belongs there. One
    that crosses a bound belongs to the section of its first byte (``start``), of
    its last (``end``), to the one with most of its bytes, the earlier in a tie
    (``majority``), or to each by its share of bytes (``split``).
    """
    k = len(bounds) - 1
    if k < 1 or not len(token_ends):
        return np.zeros(max(k, 0)), np.zeros(max(k, 0), np.int64)
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, token_ends, "left") - 1
    whole = first == last
    owned = np.bincount(first[whole] if rule not in ("start", "end") else (first if rule == "start" else last), minlength=k).astype(float)
    crossing = np.zeros(k, np.int64)
    for t in np.flatnonzero(~whole):
        parts = np.arange(first[t], last[t] + 1)
        crossing[parts[1:]] += 1
        if rule in ("majority", "split"):
            got = np.minimum(bounds[parts + 1], token_ends[t]) - np.maximum(bounds[parts], starts[t])
            if rule == "split":
                owned[parts] += got / got.sum()
            else:
                owned[parts[np.argmax(got)]] += 1
    return owned, crossing


SCHEMA = "doc_id long, section int, start_byte long, end_byte long, start_char long, n_chars long, n_tokens double, n_crossing long, doc_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_char", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])


def _counter(vocabulary: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = load_encoding(vocabulary)
        for batch in batches:
            ids, parts, held = batch.column(0), [[] for _ in range(8)], 0
            owner: list[int] = []

            def flush():
                columns = [np.concatenate(p) for p in parts]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(owner, [len(p) for p in parts[0]]))), *(pa.array(c, type=f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)

            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                data = text.encode()
                ends = np.cumsum(lengths[np.asarray(encoding.encode_ordinary(text), np.int64)])
                bounds = line_bounds(data)
                if len(bounds) < 2:
                    bounds = np.array([0, 0])
                owned, crossing = allocate(ends, bounds, rule)
                heads = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                chars = heads[bounds]
                k = len(bounds) - 1
                owner.append(row)
                for part, values in zip(parts, (np.arange(k), bounds[:-1], bounds[1:], chars[:-1], np.diff(chars), owned, crossing, np.full(k, len(ends))), strict=True):
                    part.append(values)
                held += k
                if held > 50_000:
                    yield flush()
                    owner, parts, held = [], [[] for _ in range(8)], 0
            if owner:
                yield flush()

    return run


def section_token_counts(docs: DataFrame, *, rule: str = "start", vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line of each document: its span in bytes and characters
    and the tokens it owns. Nothing is shuffled.

    A whole document is encoded once; offsets of its byte-level tokens are the
    running sum of their lengths, and a binary search joins them to the lines.
    ``rule`` says who owns a token that crosses a line's end, see
    :func:`allocate`; under every rule the lines of a document own all its tokens.
    ``n_crossing`` counts tokens that began in an earlier line.

    Null or empty text: one empty line with 0 tokens. Null ids and repeated rows
    are kept as they are. Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_counter(vocabulary, rule), SCHEMA)
