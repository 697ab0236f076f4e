"""TIFF: one row per page of each file; strips or tiles in PackBits, LZW, deflate or as they are, predictors undone."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, pieces

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_CLEAR, _END = 256, 257
#: Bytes by TIFF type: byte, ascii, short, long, rational.
_TYPES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}


def unpack_bits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += 2 + k
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2
        else:
            i += 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes, literals between them."""
    a = np.frombuffer(data, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)])) if len(a) else np.zeros(1, int)
    runs = np.flatnonzero(np.diff(starts) >= 3)
    out, at = [], 0

    def literal(to: int) -> None:
        for i in range(at, to, 128):
            part = data[i : min(i + 128, to)]
            out.append(bytes([len(part) - 1]) + part)

    for s, e in zip(starts[runs].tolist(), starts[runs + 1].tolist(), strict=True):
        literal(s)
        for i in range(s, e, 128):
            n = min(128, e - i)
            out.append(bytes([257 - n if n > 1 else 0, data[s]]))
        at = e
    literal(len(data))
    return b"".join(out)


def unlzw(data: bytes) -> bytes:
    """MSB first, 9 to 12 bits, the width grows one code early."""
    table: list[bytes] = []
    out, bits, have, width, last = [], 0, 0, 9, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == _END:
            break
        if code == _CLEAR:
            table, width, last = base.copy(), 9, b""
            continue
        if not table:
            table = base.copy()
        if not last:
            last = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
            last = now
            size = len(table) + 1
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        out.append(last)
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    table: dict[bytes, int] = {}

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    def fresh() -> dict[bytes, int]:
        return {bytes([i]): i for i in range(256)}

    table, width, size, w = fresh(), 9, 258, b""
    put(_CLEAR, 9)
    for i in range(len(data)):
        wc = w + data[i : i + 1]
        if wc in table:
            w = wc
            continue
        put(table[w], width)
        table[wc] = size
        size += 1
        w = data[i : i + 1]
        if size == 4094:
            put(table[w], 12)
            put(_CLEAR, 12)
            table, width, size, w = fresh(), 9, 258, b""
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    if w:
        put(table[w], width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(_END, width)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


_DECODE = {NONE: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}
_ENCODE = {NONE: bytes, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        where = at + 10 + 12 * i
        if _TYPES[kind] * count > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        code = {1: "B", 2: "B", 3: "H", 4: "I", 5: "I"}[kind]
        tags[tag] = list(struct.unpack_from(f"{order}{count * (2 if kind == 5 else 1)}{code}", data, where))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _block(data: bytes, rows: int, cols: int, samples: int, bits: int, compression: int, predictor: int, order: str) -> np.ndarray:
    """A decoded strip or tile as rows x cols x samples."""
    if compression not in _DECODE:
        raise ValueError(f"compression {compression} isn't supported")
    kind = np.dtype({8: "u1", 16: order + "u2"}[bits])
    raw = _DECODE[compression](data)[: rows * cols * samples * kind.itemsize]
    a = np.frombuffer(raw, kind).reshape(rows, cols, samples)
    if predictor == 2:
        a = np.cumsum(a, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} isn't supported")
    return a


def read_pages(data: bytes) -> Iterator[dict]:
    """Each page: width, height, samples, bits, compression, predictor and pixels (row by row, little-endian, samples interleaved)."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a cycle")
        seen.add(at)
        tags, at = _directory(data, at, order)
        one = lambda tag, other=None: tags.get(tag, [other])[0]
        width, height, samples, bits = one(256), one(257), one(277, 1), one(258, 1)
        compression, predictor = one(259, NONE), one(317, 1)
        if bits not in (8, 16):
            raise ValueError(f"{bits} bits a sample aren't supported")
        planes = samples if one(284, 1) == 2 else 1
        each = samples // planes
        image = np.zeros((height, width, samples), {8: "u1", 16: "<u2"}[bits])
        if 322 in tags:
            w, h, offsets, sizes = one(322), one(323), tags[324], tags[325]
        else:
            w, h, offsets, sizes = width, min(one(278, height), height), tags[273], tags[279]
        across, down = -(-width // w), -(-height // h)
        for k, (o, s) in enumerate(zip(offsets, sizes, strict=True)):
            plane, y, x = k // (across * down), k % (across * down) // across * h, k % across * w
            rows = h if 322 in tags else min(h, height - y)
            part = _block(data[o : o + s], rows, w, each, bits, compression, predictor, order)
            image[y : y + h, x : x + w, plane * each : (plane + 1) * each] = part[: height - y, : width - x]
        yield {"width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "pixels": image.tobytes()}


def write_tiff(pages: list[dict]) -> bytes:
    """A little-endian file of 8-bit grey pages: width, pixels, compression, predictor, and rows (of a strip) or tile (its side)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for p in pages:
        a = np.frombuffer(p["pixels"], np.uint8).reshape(-1, p["width"])
        height, width = a.shape
        tile, rows = p.get("tile"), p.get("rows", height)
        blocks = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile), np.uint8)
                    part = a[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [a[y : y + rows] for y in range(0, height, rows)]
        if p["predictor"] == 2:
            blocks = [np.diff(b, axis=1, prepend=np.zeros((len(b), 1), np.uint8)) for b in blocks]
        offsets, sizes = [], []
        for b in blocks:
            coded = _ENCODE[p["compression"]](b.tobytes())
            offsets.append(len(out))
            sizes.append(len(coded))
            out += coded + b"\0" * (len(coded) % 2)
        tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [8]), 259: (3, [p["compression"]]), 262: (3, [1]), 277: (3, [1]), 317: (3, [p["predictor"]])}
        tags |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, sizes)} if tile else {273: (4, offsets), 278: (4, [rows]), 279: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            coded = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(coded) > 4:
                entries += struct.pack("<HHII", tag, kind, len(values), len(out))
                out += coded
            else:
                entries += struct.pack("<HHI", tag, kind, len(values)) + coded.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


_PAGE = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]
PAGE_DDL = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def tiff_pages(files: DataFrame, content: str = "content", keys: list[str] | None = None) -> DataFrame:
    """One row per page of each file, its pages together and in order: the keys (all other columns unless named), then
    page (from 0), width, height, samples, bits, compression, predictor, pixels and error.

    A file that is null, empty or can't be decoded gives, after the pages before the fault, a row with null page and the
    error. Repeated rows stay repeated. Key columns of the names above must be renamed before.
    """
    keys = [c for c in files.columns if c != content] if keys is None else keys
    picked = files.select(*keys, content)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*keys).schema] + [PAGE_DDL])

    def decode(batches):
        for batch in pieces(batches, content):
            which, pages = [], []
            for i, data in enumerate(batch.column(content).to_pylist()):
                try:
                    for n, page in enumerate(read_pages(data or b"")):
                        which.append(i)
                        pages.append(page | {"page": n})
                except (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, struct.error, zlib.error) as e:
                    which.append(i)
                    pages.append({"error": f"{type(e).__name__}: {e}"[:200]})
            take = pa.array(which, pa.int64())
            own = [batch.column(k).take(take) for k in keys]
            yield pa.RecordBatch.from_arrays(own + [pa.array([p.get(n) for p in pages], t) for n, t in _PAGE], names=[*keys, *(n for n, _ in _PAGE)])

    return picked.mapInArrow(decode, schema)


#: Pages of the query: samples a row, rows a page, rows a strip or tile side.
WIDTH, ROWS, SIDE = 64, 256, 64
#: By page number modulo 3: compression, predictor, tiled.
KINDS = ((DEFLATE, 2, False), (PACKBITS, 1, False), (LZW, 2, True))


def payload(text: bytes) -> bytes:
    """text with bytes 0 up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def text_tiff(text: bytes) -> bytes:
    """The payload as 8-bit samples in pages that take turns in their compression; the same for equal texts."""
    data, size, pages = payload(text), WIDTH * ROWS, []
    for n, at in enumerate(range(0, len(data), size)):
        compression, predictor, tiled = KINDS[n % 3]
        page = {"width": WIDTH, "pixels": data[at : at + size], "compression": compression, "predictor": predictor}
        pages.append(page | ({"tile": SIDE} if tiled else {"rows": SIDE}))
    return write_tiff(pages)


def texts_as_tiff(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_bytes, media_bytes, media_sha256 and content of each text (null: empty)."""
    picked = docs.select(key, text)

    def encode(batches):
        for batch in pieces(batches, text):
            raw = [(x or "").encode() for x in batch.column(text).to_pylist()]
            made = [text_tiff(x) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(map(len, raw), pa.int64()), pa.array(map(len, made), pa.int64()), pa.array(hashlib.sha256(x).hexdigest() for x in made), pa.array(made, pa.binary())], names=[key, "n_bytes", "media_bytes", "media_sha256", "content"])

    return picked.mapInArrow(encode, f"`{key}` {picked.schema[key].dataType.simpleString()}, n_bytes long, media_bytes long, media_sha256 string, content binary")


class _Digest:
    def __init__(self, head: tuple):
        self.head, self.n, self.sha, self.tail, self.pages = head, 0, hashlib.sha256(), b"", 0
        self.hist, self.columns = np.zeros(256, np.int64), np.zeros(WIDTH, np.int64)

    def add(self, pixels: bytes) -> None:
        a = np.frombuffer(pixels, np.uint8)
        self.n += len(pixels)
        self.pages += 1
        self.sha.update(pixels)
        self.tail = pixels[-64:]
        self.hist += np.bincount(a, minlength=256)
        self.columns += a.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)

    def row(self) -> tuple:
        p = self.hist[self.hist > 0] / self.n
        bits = self.columns * WIDTH > self.columns.sum()
        feature = f"{self.pages};{(self.hist @ np.arange(256)) / self.n:.4f};{-(p @ np.log2(p)) + 0.0:.4f};{int.from_bytes(np.packbits(bits).tobytes()):016x}"
        key, n_bytes, media_bytes, media = self.head
        return key, n_bytes, self.n, self.sha.hexdigest(), zlib.crc32(self.tail), media_bytes, media, feature


def page_digests(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each file of tiff_pages(texts_as_tiff(...)): its pages come together and in order, so one pass without a shuffle."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches):
        now, done = None, []
        for batch in batches:
            for k, n, m, h, page, pixels, error in zip(*(batch.column(c).to_pylist() for c in (key, "n_bytes", "media_bytes", "media_sha256", "page", "pixels", "error")), strict=True):
                if error:
                    raise ValueError(error)
                if page == 0:
                    if now:
                        done.append(now.row())
                    now = _Digest((k, n, m, h))
                now.add(pixels)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), types, strict=True)], names=names)

    kind = pages.schema[key].dataType.simpleString()
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind], pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pages.mapInArrow(digest, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_digests(tiff_pages(texts_as_tiff(documents(spark, sf_dir))))
