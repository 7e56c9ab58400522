"""TIFF: pages in a binary column, decoded one row per page, and payloads stored as pages.

The reader walks the chain of image directories (classic and big, either byte order), decodes strips and tiles that are
plain, PackBits, LZW or deflate, undoes the horizontal and the floating point predictor, and puts planes together. The
writer stores 8-bit samples in strips with any of these codecs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 and BigTIFF specifications: tags, field types and their sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
FIELD_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
SCHEMES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
OLD_DEFLATE = 32946


class TiffError(ValueError):
    """The file can't be decoded; the message says why."""


# -- codecs


def unpack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128 and at + 1 < len(raw):
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        run = 1
        while run < 128 and at + run < len(raw) and raw[at + run] == raw[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, raw[at]])
            at += run
            continue
        stop = at + 1
        while stop < len(raw) and stop - at < 128 and not (stop + 1 < len(raw) and raw[stop] == raw[stop + 1]):
            stop += 1
        out += bytes([stop - at - 1]) + raw[at:stop]
        at = stop
    return bytes(out)


#: LZW's codes for clearing the table and for the end, and the widest code.
CLEAR, END, WIDEST = 256, 257, 12


def unpack_lzw(raw: bytes) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    width, previous, held, n_held = 9, None, 0, 0
    for byte in raw:
        held, n_held = (held << 8) | byte, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code = held >> n_held
        held &= (1 << n_held) - 1
        if code == CLEAR:
            del table[258:]
            width, previous = 9, None
            continue
        if code == END:
            break
        if previous is None:
            if code > 255:
                raise TiffError("an LZW strip begins with no literal")
            entry = table[code]
        else:
            if code > len(table):
                raise TiffError("bad LZW code")
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out.append(entry)
        previous = entry
        if len(table) + 1 >= 1 << width and width < WIDEST:  # codes widen one entry early
            width += 1
    return b"".join(out)


def pack_lzw(raw: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    free, width, held, n_held, out = 258, 9, CLEAR, 9, bytearray()

    def flush() -> None:
        nonlocal held, n_held
        while n_held >= 8:
            n_held -= 8
            out.append(held >> n_held)
            held &= (1 << n_held) - 1

    flush()
    word = b""
    for i in range(len(raw)):
        more = word + raw[i : i + 1]
        if more in table:
            word = more
            continue
        held, n_held = (held << width) | table[word], n_held + width
        flush()
        table[more] = free
        free += 1
        word = raw[i : i + 1]
        if free + 1 > 1 << width:
            if width < WIDEST:
                width += 1
            else:
                held, n_held = (held << width) | CLEAR, n_held + width
                flush()
                table = {bytes([k]): k for k in range(256)}
                free, width = 258, 9
    if word:
        held, n_held = (held << width) | table[word], n_held + width
        flush()
        if free + 2 > 1 << width and width < WIDEST:
            width += 1
    held, n_held = (held << width) | END, n_held + width
    flush()
    if n_held:
        out.append((held << (8 - n_held)) & 255)
    return bytes(out)


def _decode(scheme: int, raw: bytes, size: int) -> bytes:
    if scheme == 1:
        out = raw
    elif scheme == SCHEMES["packbits"]:
        out = unpack_bits(raw)
    elif scheme == SCHEMES["lzw"]:
        out = unpack_lzw(raw)
    elif scheme in (SCHEMES["deflate"], OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(raw)
        except zlib.error as e:
            raise TiffError(f"bad deflate data: {e}") from e
    else:
        raise TiffError(f"compression {scheme} is not supported")
    if len(out) < size:
        raise TiffError(f"a strip or tile has {len(out)} of {size} bytes")
    return out[:size]


def _encode(codec: str, raw: bytes, level: int) -> bytes:
    return {"none": lambda: raw, "packbits": lambda: pack_bits(raw), "lzw": lambda: pack_lzw(raw), "deflate": lambda: zlib.compress(raw, level)}[codec]()


def _unpredict(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows x columns x samples, as stored."""
    if predictor == 1:
        return block
    if predictor == 2:
        if block.dtype.kind == "f":
            raise TiffError("horizontal differences of floating point samples")
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        planes = np.frombuffer(block.tobytes(), np.uint8).reshape(rows, columns * samples * size)
        # differences run over the row's bytes, whose most significant ones come first
        summed = np.cumsum(planes.reshape(rows, columns * size, samples), axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples).astype(f"<f{size}")
    raise TiffError(f"predictor {predictor} is not supported")


# -- reader


def _directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        raise TiffError("no TIFF header")
    kind = struct.unpack_from(order + "H", raw, 2)[0]
    if kind == 42:
        count, entry, offset, at = "H", "I", 4, struct.unpack_from(order + "I", raw, 4)[0]
    elif kind == 43 and len(raw) >= 16:
        count, entry, offset, at = "Q", "Q", 8, struct.unpack_from(order + "Q", raw, 8)[0]
    else:
        raise TiffError("no TIFF header")
    seen: set[int] = set()
    try:
        while at:
            if at in seen:
                raise TiffError("the directories form a ring")
            seen.add(at)
            n = struct.unpack_from(order + count, raw, at)[0]
            at += struct.calcsize(order + count)
            tags: dict[int, tuple] = {}
            for _ in range(n):
                tag, code = struct.unpack_from(order + "HH", raw, at)
                values = struct.unpack_from(order + entry, raw, at + 4)[0]
                letter = FIELD_TYPES.get(code)
                if letter:
                    size = struct.calcsize(order + letter) * values
                    place = at + 4 + offset
                    if size > offset:
                        place = struct.unpack_from(order + entry, raw, place)[0]
                    if place + size > len(raw):
                        raise TiffError("a field lies outside the file")
                    tags[tag] = struct.unpack_from(f"{order}{values}{letter}", raw, place)
                at += 4 + 2 * offset
            yield order, tags
            at = struct.unpack_from(order + entry, raw, at)[0]
    except struct.error as e:
        raise TiffError("a directory lies outside the file") from e


def _page(raw: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    def one(tag: int, default: int | None = None) -> int:
        if tag in tags and tags[tag]:
            return int(tags[tag][0])
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits = set(tags.get(BITS, (1,)))
    kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
    if len(bits) != 1 or kind is None or min(bits) not in ((8, 16, 32, 64) if kind != "f" else (16, 32, 64)):
        raise TiffError(f"samples of {sorted(bits)} bits are not supported")
    size = bits.pop() // 8
    dtype = np.dtype(f"{order}{kind}{size}" if size > 1 else f"{kind}1")
    scheme, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, lengths = (tags.get(TILE_OFFSETS), tags.get(TILE_BYTES)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_BYTES))
    if not offsets or not lengths or not width or not height or not across or not down:
        raise TiffError("the page has no data")
    per = samples if planar == 1 else 1
    columns, rows = -(-width // across), -(-height // down)
    planes = 1 if planar == 1 else samples
    if min(len(offsets), len(lengths)) < columns * rows * planes:
        raise TiffError("strips or tiles are missing")
    out = np.zeros((height, width, samples), dtype.newbyteorder("<") if size > 1 else dtype)
    k = 0
    for plane in range(planes):
        for r in range(rows):
            for c in range(columns):
                tall = down if tiled else min(down, height - r * down)
                if offsets[k] + lengths[k] > len(raw):
                    raise TiffError("a strip or tile lies outside the file")
                data = _decode(scheme, raw[offsets[k] : offsets[k] + lengths[k]], tall * across * per * size)
                block = _unpredict(np.frombuffer(data, dtype).reshape(tall, across, per), predictor, order)
                y, x = r * down, c * across
                part = block[: height - y, : width - x]
                out[y : y + len(part), x : x + part.shape[1], plane : plane + per] = part
                k += 1
    return out


def read_pages(raw: bytes) -> list[np.ndarray]:
    """Each page as height x width x samples, little-endian."""
    return [_page(raw, order, tags) for order, tags in _directories(raw)]


# -- writer


def write_pages(pages: list[np.ndarray], codec: str = "deflate", predictor: int = 2, rows_per_strip: int = 256, level: int = 6) -> bytes:
    """A little-endian file of 8-bit pages (height x width x samples), in strips."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        height, width, samples = page.shape
        strips = []
        for y in range(0, height, rows_per_strip):
            block = page[y : y + rows_per_strip]
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], 1)
            strips.append(_encode(codec, block.astype(np.uint8).tobytes(), level))
        offsets = []
        for strip in strips:
            offsets.append(len(out))
            out += strip
        fields = [
            (WIDTH, "I", [width]),
            (HEIGHT, "I", [height]),
            (BITS, "H", [8] * samples),
            (COMPRESSION, "H", [SCHEMES[codec]]),
            (PHOTOMETRIC, "H", [2 if samples == 3 else 1]),
            (STRIP_OFFSETS, "I", offsets),
            (SAMPLES, "H", [samples]),
            (ROWS_PER_STRIP, "I", [rows_per_strip]),
            (STRIP_BYTES, "I", [len(s) for s in strips]),
            (PLANAR, "H", [1]),
            (PREDICTOR, "H", [predictor]),
        ]
        entries = []
        for tag, letter, values in fields:
            data = struct.pack(f"<{len(values)}{letter}", *values)
            if len(data) > 4:
                place = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack("<I", place)
            entries.append(struct.pack("<HHI", tag, 3 if letter == "H" else 4, len(values)) + data.ljust(4, b"\0"))
        if len(out) % 2:
            out += b"\0"
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# -- Spark

#: Pixels in a row of a stored payload, and samples in a pixel.
ROW, CHANNELS = 64, 3


def features(page: np.ndarray) -> str:
    """Size, mean and deviation of each sample, and the entropy of all in bits."""
    flat = page.reshape(-1, page.shape[2]).astype(np.float64)
    mean, sd = flat.mean(0), flat.std(0)
    _, counts = np.unique(page, return_counts=True) if page.dtype.itemsize > 1 else (None, np.bincount(page.ravel().view(np.uint8), minlength=256))
    share = counts[counts > 0] / counts.sum()
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    listed = [",".join(f"{v:.4f}" for v in x) for x in (mean, sd)]
    return f"{page.shape[1]}x{page.shape[0]}x{page.shape[2]};mean={listed[0]};sd={listed[1]};entropy={entropy:.4f}"


def payload_page(text: str) -> tuple[np.ndarray, int]:
    """The text's bytes as a page, spaces filling its last row, and how many are the text's own."""
    raw = text.encode("utf-8", "surrogatepass")
    unit = ROW * CHANNELS
    padded = raw + b" " * (-len(raw) % unit if raw else unit)
    return np.frombuffer(padded, np.uint8).reshape(-1, ROW, CHANNELS), len(raw)


def store_texts(docs: DataFrame, codec: str = "deflate", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (a one-page TIFF) of every row; a null text is empty and becomes one row of spaces."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload_page(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for _, n in made], pa.int64()),
                    pa.array([write_pages([page], codec) for page, _ in made], pa.large_binary()).cast(pa.binary()),
                ],
                names=["doc_id", "n_bytes", "media"],
            )

    return rows.mapInArrow(stored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media's columns and page (0, 1, ...), width, height, samples, dtype, pixels, feature, error: one row per page.

    A file that can't be decoded gives one row with its error and nulls; a null one a row of nulls. Repeated rows give repeated
    rows, an empty table none. A column of media that is called as one of the new ones is renamed, with media_ before it.
    """
    at = media.columns.index(media_col)
    extra = "page int, width int, height int, samples int, dtype string, pixels binary, feature string, error string"
    taken = {x.split()[0] for x in extra.split(", ")}
    fresh: list[str] = []
    for name in media.columns:
        while name.lower() in taken:
            name = f"media_{name}"
        taken.add(name.lower())
        fresh.append(name)
    media = media.toDF(*fresh)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields), extra])
    names = [x.split()[0] for x in extra.split(", ")]
    kinds = [pa.int32()] * 4 + [pa.string(), pa.binary(), pa.string(), pa.string()]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, raw in enumerate(batch.column(at)):
                raw = raw.as_py()
                found: list[tuple] = []
                try:
                    if raw is not None:
                        for k, page in enumerate(read_pages(raw)):
                            height, width, samples = page.shape
                            found.append((k, width, height, samples, page.dtype.name, page.tobytes(), features(page), None))
                except TiffError as e:
                    found.append((*[None] * 7, str(e)))
                for row in found or [(None,) * 8]:
                    take.append(i)
                    rows.append(row)
            own = [c.take(pa.array(take, pa.int64())) for c in batch.columns]
            made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(own + made, names=[*batch.schema.names, *names])

    return media.mapInArrow(decoded, schema)


def media_report(docs: DataFrame) -> DataFrame:
    """The digests of every text's stored page, from what is read back."""
    pages = decode_pages(store_texts(docs))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
