"""TIFF pages: walk the image directories, decode strips and tiles, undo predictors.

``read_tiff`` takes a binary column and emits one row per page. It reads both
byte orders, strips and tiles, no compression, PackBits, LZW (most significant
bit first, early change) and deflate, 8, 16 and 32-bit samples, interleaved or
planar, and the horizontal predictor. ``write_tiff`` stores bytes as 8-bit grey
pages. What cannot be read becomes a row with ``error`` set, never an exception.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# fixed values: tag numbers, field types and compression codes of TIFF 6.0
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
SAMPLE_FORMAT, FLOAT = 339, 3
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 7: 1, 8: 2, 9: 4}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
CODEC = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
CLEAR, END, FIRST = 256, 257, 258

#: A page of more samples than this is refused, so a damaged header cannot ask for unbounded memory.
MAX_PAGE_BYTES = 1 << 30
SAMPLE_WIDTH = 64
PAGE_ROWS = 2048


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes are repeated, the rest stored in literals of up to 128."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edge = np.flatnonzero(np.diff(a)) + 1
    begin = np.concatenate([[0], edge])
    length = np.diff(np.concatenate([begin, [len(a)]]))
    out, done = bytearray(), 0

    def literal(upto: int) -> None:
        nonlocal done
        while done < upto:
            n = min(128, upto - done)
            out.append(n - 1)
            out.extend(data[done : done + n])
            done += n

    for k in np.flatnonzero(length >= 3):
        at, n = int(begin[k]), int(length[k])
        literal(at)
        while n:
            m = min(128, n)
            if m < 2:
                literal(done + m)
            else:
                out.append(257 - m)
                out.append(data[at])
                done += m
            n -= m
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, limit: int) -> bytes:
    out, at, size = bytearray(), 0, len(data)
    while at < size and len(out) < limit:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, widened one code early; the table is cleared when full."""
    codes, widths = [CLEAR], [9]
    table: dict[int, int] = {}
    following, width, room = FIRST, 9, 512
    if data:
        prefix = data[0]
        for byte in memoryview(data)[1:]:
            key = prefix << 8 | byte
            code = table.get(key)
            if code is not None:
                prefix = code
                continue
            codes.append(prefix)
            widths.append(width)
            table[key] = following
            following += 1
            if following == room:
                if width == 12:
                    codes.append(CLEAR)
                    widths.append(12)
                    table = {}
                    following, width = FIRST, 9
                else:
                    width += 1
                room = 4095 if width == 12 else 1 << width
            prefix = byte
        codes.append(prefix)
        widths.append(width)
        if following + 1 == room and width < 12:
            width += 1
    codes.append(END)
    widths.append(width)
    # every code's bits, most significant first
    c, w = np.array(codes, np.uint16), np.array(widths)
    bits = np.unpackbits(c.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= (16 - w)[:, None]]).tobytes()


def lzw_decode(data: bytes, limit: int) -> bytes:
    parts: list[bytes] = []
    roots = [bytes((i,)) for i in range(256)] + [b"", b""]
    table = list(roots)
    width, held, have, made = 9, 0, 0, 0
    last = b""
    for byte in data:
        held = held << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code < 256 or code > END:
            if not last:
                if code > 255:
                    raise ValueError("LZW stream begins with a table code")
                entry = roots[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code out of range")
                table.append(last + entry[:1])
                n = len(table)
                if n >= 511:
                    width = 10 if n < 1023 else 11 if n < 2047 else 12
            parts.append(entry)
            made += len(entry)
            if made >= limit:
                break
            last = entry
        elif code == CLEAR:
            table = list(roots)
            width, last = 9, b""
        else:
            break
    return b"".join(parts)


#: What reading damaged bytes may raise: fields cut off, values out of range, sizes that no integer or memory holds.
DAMAGE = (struct.error, ValueError, OverflowError, MemoryError, zlib.error)


def _unpack(codec: int, data: bytes, limit: int) -> bytes:
    name = CODEC.get(codec)
    if name == "none":
        return data[:limit]
    if name == "packbits":
        return packbits_decode(data, limit)[:limit]
    if name == "lzw":
        return lzw_decode(data, limit)[:limit]
    if name == "deflate":
        return zlib.decompressobj().decompress(data, limit)
    raise ValueError(f"compression {codec} is not supported")


def _pack(codec: int, data: bytes) -> bytes:
    name = CODEC[codec]
    return packbits_encode(data) if name == "packbits" else lzw_encode(data) if name == "lzw" else zlib.compress(data, 1) if name == "deflate" else data


def encode_tiff(pages: list[np.ndarray], codec: int, predictor: int = 1, tile: int = 0, strip_rows: int = 512) -> bytes:
    """Little-endian TIFF of grey pages of bytes or floating point numbers; ``tile`` above 0 stores square tiles of that side.

    ``predictor`` 2 stores differences of bytes, 3 those of the byte planes of
    floating point numbers.
    """
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        rows, width = page.shape
        if tile:
            high, wide = -(-rows // tile) * tile, -(-width // tile) * tile
            full = np.zeros((high, wide), page.dtype)
            full[:rows, :width] = page
            blocks = [full[y : y + tile, x : x + tile] for y in range(0, high, tile) for x in range(0, wide, tile)]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, rows, strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            elif predictor == 3:
                planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(len(block), -1, block.itemsize).transpose(0, 2, 1).reshape(len(block), -1)
                block = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1)
            packed = _pack(codec, block.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        chunk = [(TILE_WIDTH, [tile]), (TILE_LENGTH, [tile]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)] if tile else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [strip_rows]), (STRIP_COUNTS, counts)]
        fields = sorted([(WIDTH, [width]), (LENGTH, [rows]), (BITS, [8 * page.itemsize]), (COMPRESSION, [codec]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor]), *chunk, *([(SAMPLE_FORMAT, [FLOAT])] if page.dtype.kind == "f" else [])])
        far = {}
        for tag, values in fields:
            if len(values) > 1:
                out += b"\0" * (len(out) % 2)
                far[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, values in fields:
            out += struct.pack("<HHII", tag, 4, len(values), far.get(tag, values[0]))
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, list[int]] = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind not in TYPE_CODE or count == 0:
            continue
        size = TYPE_SIZE[kind] * count
        place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        if place + size > len(data):
            raise ValueError(f"tag {tag} lies outside the file")
        tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, place))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, list[int]], order: str) -> tuple[np.ndarray, str]:
    get = lambda tag, other: tags.get(tag, [other])[0]
    width, rows, samples = get(WIDTH, 0), get(LENGTH, 0), get(SAMPLES, 1)
    bits, codec, predictor = get(BITS, 1), get(COMPRESSION, 1), get(PREDICTOR, 1)
    form = "f" if get(SAMPLE_FORMAT, 1) == FLOAT else "u"
    if bits not in ((16, 32, 64) if form == "f" else (8, 16, 32)) or len(set(tags.get(BITS, [bits]))) > 1:
        raise ValueError(f"{bits}-bit samples are not supported")
    if predictor not in ((1, 3) if form == "f" else (1, 2)):
        raise ValueError(f"predictor {predictor} is not supported")
    kind = np.dtype(f"{'<' if order == '<' else '>'}{form}{bits // 8}")
    if width * rows * samples * kind.itemsize > MAX_PAGE_BYTES or width <= 0 or rows <= 0 or samples <= 0:
        raise ValueError(f"page of {width} x {rows} x {samples} refused")
    tiled = TILE_OFFSETS in tags
    wide, high = (get(TILE_WIDTH, 0), get(TILE_LENGTH, 0)) if tiled else (width, min(get(ROWS_PER_STRIP, rows), rows))
    if wide <= 0 or high <= 0:
        raise ValueError("chunks without a size")
    offsets, counts = (tags.get(TILE_OFFSETS, []), tags.get(TILE_COUNTS, [])) if tiled else (tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, []))
    planes = samples if get(PLANAR, 1) == 2 else 1
    deep = 1 if planes > 1 else samples
    across, down = -(-width // wide), -(-rows // high)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("chunks are missing")
    out = np.zeros((rows, width, samples), kind)
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * high, cell % across * wide
        tall = high if tiled else min(high, rows - y)
        need = tall * wide * deep * kind.itemsize
        raw = _unpack(codec, data[offsets[k] : offsets[k] + counts[k]], need)
        if len(raw) < need:
            raise ValueError(f"chunk {k} ends early")
        if predictor == 3:  # differences run over the byte planes of a row, the highest byte's first, whatever the file's byte order
            levels = np.cumsum(np.frombuffer(raw, np.uint8).reshape(tall, -1, deep), axis=1, dtype=np.uint8)
            whole = np.ascontiguousarray(levels.reshape(tall, kind.itemsize, -1).transpose(0, 2, 1))
            block = whole.view(kind.newbyteorder(">")).reshape(tall, wide, deep)
        else:
            block = np.frombuffer(raw, kind).reshape(tall, wide, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        block = block[: rows - y, : width - x]
        out[y : y + tall, x : x + wide, plane if planes > 1 else slice(None)] = block[..., 0] if planes > 1 else block
    return out, f"{CODEC[codec]}/{'tiles' if tiled else 'strips'}/{predictor}"


def decode_tiff(data: bytes | None) -> Iterator[tuple[int, np.ndarray | None, str | None, str | None]]:
    """(page, samples as rows x width x channels, form, error) of each directory; one error row for an unreadable file."""
    if data is None:
        yield 0, None, None, "null"
        return
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        yield 0, None, None, "not a TIFF file"
        return
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    page = 0
    while at:
        if at in seen:
            yield page, None, None, "directories form a loop"
            return
        seen.add(at)
        try:
            tags, at = _directory(data, at, order)
        except DAMAGE as e:
            yield page, None, None, str(e)
            return
        try:
            samples, form = _page(data, tags, order)
            yield page, samples, form, None
        except DAMAGE as e:
            yield page, None, None, str(e)
        page += 1
    if not page:
        yield 0, None, None, "no image directory"


def read_tiff(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """One row per page: ``keep`` columns, then ``page, width, height, channels, bits, form, samples, error``.

    Pages of a file follow each other in page order. A null, empty or damaged
    file gives one row with ``error``; an unreadable page gives its own error row
    and the pages after it still come. Repeated rows repeat their pages, an empty
    table gives none. Only ``keep`` and ``media_col`` are read; a kept column with
    a name of the output's gets underscores appended. Samples of more than a byte
    are written least byte first, whatever the file's order.
    """
    names = ["page", "width", "height", "channels", "bits", "form", "samples", "error"]
    kinds = []
    for c in keep:
        name = c
        while name in names:
            name += "_"
        names.append(name)
        kinds.append(f"`{name}` {df.schema[c].dataType.simpleString()}")
    kinds = ", ".join(kinds)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *kept, media in rows:
            for page, samples, form, error in decode_tiff(media):
                if samples is None:
                    yield *kept, page, None, None, None, None, None, None, error
                else:
                    high, wide, deep = samples.shape
                    yield *kept, page, wide, high, deep, samples.itemsize * 8, form, samples.astype(samples.dtype.newbyteorder("<")).tobytes(), None

    schema = f"{kinds}{', ' if kinds else ''}page int, width int, height int, channels int, bits int, form string, samples binary, error string"
    return map_rows(df.select(*keep, media_col), run, schema)


def write_tiff(df: DataFrame, payload_col: str, keep: list[str], width: int = SAMPLE_WIDTH, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``keep`` columns and ``media``: each binary payload (a multiple of ``width`` bytes) as a TIFF file.

    Pages hold up to ``page_rows`` rows. The form follows from the payload alone:
    its row count picks PackBits, LZW or deflate with the horizontal predictor,
    in strips or in tiles, so a table exercises every path. A null payload gives
    null media; an empty one a file without pages.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    forms = ((32773, 1), (5, 1), (8, 2))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *kept, payload in rows:
            if payload is None:
                yield *kept, None
                continue
            grid = np.frombuffer(payload, np.uint8).reshape(-1, width)
            codec, predictor = forms[len(grid) % 3]
            tile = 64 if len(grid) // 3 % 2 else 0
            yield *kept, encode_tiff([grid[y : y + page_rows] for y in range(0, len(grid), page_rows)], codec, predictor, tile)

    return map_rows(df.select(*keep, payload_col), run, f"{kinds}, media binary")


def document_digests(docs: DataFrame) -> DataFrame:
    """Store every document's bytes as TIFF, read the pages back, digest them per document.

    Texts are padded with zero bytes to a positive multiple of 64; null counts as
    empty. No shuffle: the pages of a file stay together and in order.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(text)
    short = F.greatest(F.lit(64), F.ceil(size / 64) * 64) - size
    padding = F.substring(F.lit(b"\0" * 64), F.lit(1), short.cast("int"))
    source = docs.select("doc_id", size.cast("long").alias("n_bytes"), F.concat(text, padding).alias("payload"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    media = write_tiff(source, "payload", ["doc_id", "n_bytes"])
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = read_tiff(media, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        import hashlib

        def done(state):
            head, sha, tail, size, form, counts, edges, pages, error = state
            mean = int((counts * np.arange(256)).sum()) * 1000 // max(size, 1)
            kinds = int((counts > 0).sum())
            feature = error or f"pages={pages};form={form};mean_milli={mean};values={kinds};zeros={int(counts[0])};edges={edges}"
            return head[0], head[1], size, sha.hexdigest(), zlib.crc32(tail), head[2], head[3], feature

        state = None
        for *head, page, _w, _h, _c, _b, form, samples, error in rows:
            if page == 0:
                if state:
                    yield done(state)
                state = [head, hashlib.sha256(), b"", 0, form, np.zeros(256, np.int64), 0, 0, None]
            data = samples or b""
            a = np.frombuffer(data, np.uint8)
            state[1].update(data)
            state[2] = (state[2] + data[-64:])[-64:]
            state[3] += len(data)
            state[5] += np.bincount(a, minlength=256)
            state[6] += int(np.count_nonzero(a[1:] != a[:-1]))
            state[7] += 1
            state[8] = state[8] or error
        if state:
            yield done(state)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(pages, fold, schema, rows=4096)
