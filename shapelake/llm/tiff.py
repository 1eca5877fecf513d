"""TIFF columns: one row for each page; and a writer of lossless 8-bit pages."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: compressions, tags, and sizes of field types.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
CLEAR, STOP = 256, 257
#: Most bytes that one byte of a strip or tile can stand for.
EXPANDS = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}


def lzw_decode(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, widened one code early."""
    out, at, held, bits, width = bytearray(), 0, 0, 0, 9
    base = [bytes((k,)) for k in range(256)] + [b"", b""]
    words, last = list(base), b""
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held, bits, at = ((held & 0xFFFFFF) << 8) | data[at], bits + 8, at + 1
        code = (held >> (bits - width)) & ((1 << width) - 1)
        bits -= width
        if code == STOP:
            return bytes(out)
        if code == CLEAR:
            words, width, last = list(base), 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code before its entry")
        out += word
        if last:
            words.append(last + word[:1])
            if len(words) >= (1 << width) - 1 and width < 12:
                width += 1
        last = word


def lzw_encode(data: bytes) -> bytes:
    codes, widths, table, nxt, width, held = [CLEAR], [9], {}, 258, 9, -1
    for byte in data:
        if held < 0:
            held = byte
            continue
        key = (held << 8) | byte
        found = table.get(key)
        if found is not None:
            held = found
            continue
        codes.append(held)
        widths.append(width)
        table[key] = nxt
        nxt += 1
        held = byte
        if nxt == 4094:
            codes.append(CLEAR)
            widths.append(12)
            table, nxt, width = {}, 258, 9
        elif nxt == 1 << width:
            width += 1
    if held >= 0:
        codes.append(held)
        widths.append(width)
        if nxt + 1 == 1 << width and width < 12:
            width += 1
    codes.append(STOP)
    widths.append(width)
    grid = np.unpackbits(np.array(codes, ">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(grid[np.arange(16)[None, :] >= 16 - np.array(widths)[:, None]]).tobytes()


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more as runs, the rest as literals of at most 128 bytes."""
    values = np.frombuffer(data, np.uint8)
    cuts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)])) if len(values) else np.zeros(1, int)
    long = np.flatnonzero(np.diff(cuts) >= 3)
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for a, b in zip(cuts[long].tolist(), cuts[long + 1].tolist(), strict=True):
        literal(a)
        while b - a >= 2:
            n = min(128, b - a)
            out.extend((257 - n, data[a]))
            a += n
        at = a
    literal(len(data))
    return bytes(out)


def _inflate(data: bytes, limit: int) -> bytes:
    return zlib.decompressobj().decompress(data, limit)


def predict(rows: np.ndarray) -> np.ndarray:
    """Horizontal differences over axis 1 of (rows, width, samples)."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def undo(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(rows, axis=1, dtype=rows.dtype)


def encode_page(payload: bytes, *, compression: int = DEFLATE, predictor: int = 1, tile: int = 0, width: int = 64, samples: int = 3, block: int = 32_768, level: int = 6) -> bytes:
    """One page of 8-bit samples holding ``payload``, whose length is a multiple
    of ``width * samples``; in strips of about ``block`` bytes, or tiles of side ``tile``."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width, samples)
    height = len(image)
    if tile:
        step = tile
        pieces = []
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                padded = np.zeros((tile, tile, samples), np.uint8)
                part = image[y : y + tile, x : x + tile]
                padded[: part.shape[0], : part.shape[1]] = part
                pieces.append(padded)
    else:
        step = max(1, block // (width * samples))
        pieces = [image[y : y + step] for y in range(0, height, step)]
    pack = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, level), PACKBITS: packbits_encode}[compression]

    def packed(piece: np.ndarray) -> bytes:
        piece = predict(piece) if predictor == 2 else piece
        # PackBits must not run over the end of a row
        return b"".join(pack(row.tobytes()) for row in piece) if compression == PACKBITS else pack(piece.tobytes())

    blocks = [packed(p) for p in pieces]
    offsets, at = [], 8
    for b in blocks:
        offsets.append(at)
        at += len(b)
    pad = at % 2
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
    sizes = [len(b) for b in blocks]
    fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_AT, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, offsets), (ROWS, 4, [step]), (STRIP_BYTES, 4, sizes)]
    directory_at = at + pad
    extra_at, entries, extra = directory_at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, values in sorted(fields):
        raw = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return b"".join([b"II*\0", struct.pack("<I", directory_at), *blocks, b"\0" * pad, struct.pack("<H", len(fields)), entries, struct.pack("<I", 0), extra])


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory; a loop of directories ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        count, fields = struct.unpack_from(f"{order}H", data, at)[0], {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                form = f"{order}{n}{FIELD[kind]}"
                where = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    where = struct.unpack_from(f"{order}I", data, where)[0]
                fields[tag] = struct.unpack_from(form, data, where)
        yield order, fields
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)[0]


def decode_page(data: bytes, order: str, fields: dict[int, tuple]) -> tuple[np.ndarray, dict]:
    """Samples of one page as (height, width, samples), and what its directory says."""
    one = lambda tag, other: fields.get(tag, (other,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 8, 16) or predictor not in (1, 2) or compression not in NAMES or (bits == 1 and predictor == 2):
        raise ValueError(f"unsupported: {bits} bits, predictor {predictor}, compression {compression}")
    tiled = TILE_AT in fields
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
    if not all(isinstance(x, int) and x > 0 for x in (width, height, samples, bw, bh)):
        raise ValueError("sizes are not positive whole numbers")
    blocks = list(zip(fields[TILE_AT if tiled else STRIP_AT], fields[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    row_bytes = lambda w, depth: -(-w * depth * bits // 8)
    # Nothing is allocated that the blocks cannot fill.
    if height * row_bytes(width, samples) > EXPANDS[compression] * sum(min(size, max(0, len(data) - at)) for at, size in blocks) + 64:
        raise ValueError("the blocks are too short for the size stated")
    kind = np.dtype(f"{order}u2" if bits == 16 else np.uint8)
    depth, planes = (samples, 1) if planar == 1 else (1, samples)
    across, down = -(-width // bw), -(-height // bh)
    if tiled and (bw > 8 * width + 4096 or bh > 8 * height + 4096):
        raise ValueError("tiles far larger than the page")
    image = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (at, size) in enumerate(blocks):
        plane, k = divmod(k, across * down)
        if plane >= planes:
            break
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        expected, raw = rows * row_bytes(bw, depth), data[at : at + size]
        if compression == LZW:
            raw = lzw_decode(raw)
        elif compression == PACKBITS:
            raw = packbits_decode(raw)
        elif compression != NONE:
            raw = _inflate(raw, expected)
        if len(raw) < expected:
            raise ValueError("short strip or tile")
        if bits == 1:
            piece = np.unpackbits(np.frombuffer(raw, np.uint8, expected).reshape(rows, -1), axis=1)[:, : bw * depth].reshape(rows, bw, depth)
        else:
            piece = np.frombuffer(raw, kind, expected // kind.itemsize).reshape(rows, bw, depth).astype(image.dtype, copy=False)
        piece = undo(piece) if predictor == 2 else piece
        part = piece[: height - y, : width - x]
        image[y : y + part.shape[0], x : x + part.shape[1], plane : plane + depth] = part
    return image, {"width": width, "height": height, "samples": samples, "bits": bits, "compression": NAMES[compression], "predictor": predictor, "layout": "tiles" if tiled else "strips"}


PAGES = "id long, page int, width int, height int, samples int, bits int, compression string, predictor int, layout string, pixels binary, error string"


def _reader(step: int):
    names = [f.split()[0] for f in PAGES.split(", ")]

    def rows(media_id, data):
        if data is None:
            return
        page, order_fields = 0, None
        try:
            for page, order_fields in enumerate(directories(data)):  # noqa: B007
                image, said = decode_page(data, *order_fields)
                yield (media_id, page, *(said[k] for k in names[2:9]), image.tobytes(), None)
        except Exception as e:  # noqa: BLE001 - whatever damage raises is this row's error, not the job's
            yield (media_id, page, *[None] * 8, f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), step):
                part = batch.iloc[k : k + step]
                found = [r for media_id, data in zip(part["id"], part["media"], strict=True) for r in rows(media_id, data)]
                if found:
                    yield pd.DataFrame(found, columns=names).astype(dict.fromkeys(("id", "width", "height", "samples", "bits", "predictor"), "Int64"))

    return run


def read_pages(media: DataFrame, *, id_col: str = "id", media_col: str = "media", step: int = 128) -> DataFrame:
    """One row for each page of each TIFF in a binary column.

    Walks the image directories, decodes strips or tiles (stored, PackBits, LZW or
    deflate, 1, 8 or 16 bits, interleaved or planar) and undoes horizontal
    differences; bits are samples of 0 and 1, as stored. ``pixels`` are the samples, row by row, interleaved.

    Null media give no row. Damaged or unsupported media give the pages before
    the fault and one row whose ``error`` says what it is. Repeated rows are
    each read. Other columns are ignored.
    """
    return media.select(media[id_col].cast("long").alias("id"), media[media_col].alias("media")).mapInPandas(_reader(step), PAGES)


def pad(text: str | None, unit: int = 192) -> tuple[bytes, int]:
    """UTF-8 of ``text`` with spaces up to a positive multiple of ``unit``; length before."""
    data = (text or "").encode()
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b" "), len(data)


def _writer(step: int):
    #: By payload, so that equal texts are stored alike and every decoder meets real data.
    forms = [dict(compression=DEFLATE, predictor=2), dict(compression=LZW), dict(compression=DEFLATE, tile=64), dict(compression=PACKBITS), *[dict(compression=DEFLATE)] * 3, dict(compression=DEFLATE, predictor=2, tile=64)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), step):
                part = batch.iloc[k : k + step]
                padded = [pad(t) for t in part["text"]]
                media = [encode_page(p, **forms[zlib.crc32(p) % len(forms)]) for p, _ in padded]
                yield pd.DataFrame({"id": part["id"].astype("Int64").values, "n_bytes": [n for _, n in padded], "media": media})

    return run


def texts_to_tiff(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", step: int = 128) -> DataFrame:
    """Each text, padded by :func:`pad`, as the samples of a one-page TIFF 64 pixels wide.

    The payload's checksum picks deflate, LZW or PackBits, strips or tiles, with
    or without horizontal differences. A null text is an empty one.
    """
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInPandas(_writer(step), "id long, n_bytes long, media binary")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in PAGES.split(", ")]
    read, write = _reader(64), [f.split()[0] for f in DIGEST.split(", ")]
    for batch in batches:
        pages = {}
        for got in read([pd.DataFrame({"id": range(len(batch)), "media": batch["media"].values})]):
            for row in got.itertuples(index=False):
                pages[row.id] = dict(zip(names, row, strict=True))
        out = []
        for k, (doc_id, n_bytes, media) in enumerate(zip(batch["id"], batch["n_bytes"], batch["media"], strict=True)):
            page = pages[k]
            if page["error"]:
                raise ValueError(page["error"])
            samples = np.frombuffer(page["pixels"], np.uint8)
            share = np.bincount(samples, minlength=256) / len(samples)
            entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
            feature = f"{page['width']}x{page['height']}x{page['samples']} {page['compression']} {page['layout']} predictor={page['predictor']} mean={samples.mean():.4f} std={samples.std():.4f} entropy={entropy:.4f}"
            out.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pd.DataFrame(out, columns=write).astype({"doc_id": "Int64"})


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: DataFrame) -> DataFrame:
    """Digests and features of one-page media, from pages decoded as by :func:`read_pages`."""
    return media.mapInPandas(_digest, DIGEST)
