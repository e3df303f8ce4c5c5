"""Media columns: lossless storage of payloads as media files, and signature sniffing of stored bytes.

An Aho-Corasick automaton over the magic bytes of all known formats finds where a file may begin; the format's
validator then follows its structure (headers, chunk lengths, checksums) and says how long the file is, or that it is
none. What stands at the start of a blob decides its true type, whatever was declared; valid files further in are carved.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, session, table, without

#: Samples in a row of an image, and the unit that payloads are padded to.
UNIT = 192
#: Compressed bytes that go into a decompressor, and bytes that it gives out, at a time.
DEFLATED, INFLATED = 1 << 16, 1 << 20

# Magic bytes and where in a file they stand.
MAGIC = [
    (b"RIFF", 0, "wav"), (b"BM", 0, "bmp"), (b"\x89PNG\r\n\x1a\n", 0, "png"), (b"P5\n", 0, "pgm"), (b".snd", 0, "au"),
    (b"GIF87a", 0, "gif"), (b"GIF89a", 0, "gif"), (b"\xff\xd8\xff", 0, "jpeg"), (b"\x1f\x8b\x08", 0, "gzip"), (b"%PDF-", 0, "pdf"),
]
#: The formats that payloads are stored in, by crc32 of the payload modulo their number.
STORED = ("wav", "bmp", "png", "pgm", "au")


@dataclass(frozen=True)
class Found:
    """A valid file inside a blob."""

    kind: str
    start: int
    length: int
    payload: tuple[int, int] | None = None  # where its samples lie, if stored plainly
    detail: str = ""


def pad(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with blanks up to a positive multiple of the unit, and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def store(payload: bytes, kind: str) -> bytes:
    """A complete file of the kind whose 8-bit samples are the payload."""
    rows = len(payload) // UNIT
    if kind == "wav":
        return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
    if kind == "bmp":
        head = struct.pack("<IHHI", 1078 + len(payload), 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, UNIT, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
        return b"BM" + head + bytes(x for g in range(256) for x in (g, g, g, 0)) + payload
    if kind == "png":
        lines = np.zeros((rows, UNIT + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    if kind == "pgm":
        return f"P5\n{UNIT} {rows}\n255\n".encode() + payload
    if kind == "au":
        return b".snd" + struct.pack(">IIIII", 24, len(payload), 2, 8000, 1) + payload
    raise ValueError(f"no such stored format: {kind}")


def _wav(b: bytes, at: int) -> Found | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, k, fmt, data = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, None, None
    if end > len(b):
        return None
    while k + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, k)
        if k + 8 + n > end:
            return None
        if name == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, k + 8)
        elif name == b"data":
            data = (k + 8, n)
        k += 8 + n + (n & 1)
    return Found("wav", at, end - at, data, f"{fmt[2]}Hz/{fmt[1]}ch/{fmt[5]}bit") if fmt and data else None


def _bmp(b: bytes, at: int) -> Found | None:
    if len(b) < at + 54:
        return None
    size, zero, _, offset, head, width, height, planes, bits, packed = struct.unpack_from("<IHHIIiiHHI", b, at + 2)
    if zero or head < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or not 0 < width < 1 << 24 or not height or packed > 3 or size > len(b) - at or offset < 14 + head:
        return None
    stride = (width * bits + 31) // 32 * 4
    need = stride * abs(height) if packed in (0, 3) else 2  # run lengths end with a mark of two bytes
    if offset + need > size:
        return None
    return Found("bmp", at, size, (at + offset, need) if bits == 8 and height < 0 and stride == width and not packed else None, f"{width}x{abs(height)}x{bits}")


# Bit depths that each PNG colour type may have, and its channels.
_PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the seven passes of an interlaced PNG.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _inflated(parts: list[memoryview], most: int) -> int | None:
    """How many bytes a zlib stream in parts holds, if it ends where the parts do; None if it is broken or longer than most."""
    d, n = zlib.decompressobj(), 0
    try:
        for part in parts:
            for k in range(0, len(part), DEFLATED):
                some = part[k : k + DEFLATED]
                while True:
                    got = len(d.decompress(some, INFLATED))
                    n, some = n + got, d.unconsumed_tail
                    if n > most:
                        return None
                    if d.eof or not some and got < INFLATED:
                        break
    except zlib.error:
        return None
    return n if d.eof and not d.unused_data else None


def _png_chunks(b: bytes, at: int) -> tuple[tuple, list[tuple[int, int]], int] | None:
    """The header, where the image data lies, and the end of a PNG of sound chunks."""
    k, head, data, closed = at + 8, None, [], False
    while k + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, k)
        if n > len(b) - k - 12 or zlib.crc32(b[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return None
        if (head is None) != (kind == b"IHDR"):
            return None
        if kind == b"IHDR":
            if n != 13:
                return None
            head = struct.unpack_from(">IIBBBBB", b, k + 8)
            w, h, depth, colour, method, filtering, interlace = head
            if not w or not h or depth not in _PNG_DEPTHS.get(colour, ()) or method or filtering or interlace > 1:
                return None
        elif kind == b"IDAT":
            if closed:
                return None
            data.append((k + 8, n))
        elif data:
            closed = True
        k += 12 + n
        if kind == b"IEND":
            return (head, data, k) if data and not n else None
    return None


def _png_rows(head: tuple) -> list[tuple[int, int]]:
    """Rows, and bytes in each without its filter, of every pass."""
    w, h, depth, colour, _, _, interlace = head
    sizes = [(-(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in _PASSES] if interlace else [(w, h)]
    return [(rows, -(-cols * depth * _PNG_CHANNELS[colour] // 8)) for cols, rows in sizes if cols > 0 and rows > 0]


def _png(b: bytes, at: int) -> Found | None:
    found = _png_chunks(b, at)
    if not found:
        return None
    head, data, end = found
    need, view = sum(rows * (n + 1) for rows, n in _png_rows(head)), memoryview(b)
    if _inflated([view[k : k + n] for k, n in data], need) != need:
        return None
    return Found("png", at, end - at, None, f"{head[0]}x{head[1]}x{head[2]}" + (f"c{head[3]}" if head[3] else "") + "i" * head[6])


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray | None:
    """The bytes of an image's rows, each of which begins with its filter; step: bytes in a pixel. None for an unknown filter."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        return None
    above = np.zeros(out.shape[1], np.uint8)
    for row, kind in zip(out, kinds.tolist(), strict=True) if kinds.any() else ():
        if kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint64)
        elif kind == 2:
            row += above
        elif kind:
            now, up = row.tolist(), above.tolist()
            for i in range(len(now)):
                left = now[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    corner = up[i - step] if i >= step else 0
                    p = left + up[i] - corner
                    far = (abs(p - left), abs(p - up[i]), abs(p - corner))
                    guess = (left, up[i], corner)[far.index(min(far))]
                now[i] = (now[i] + guess) & 255
            row[:] = now
        above = row
    return out


def _pgm(b: bytes, at: int) -> Found | None:
    head = b[at : at + 40].split(b"\n", 3)
    if len(head) < 4 or len(size := head[1].split(b" ")) != 2 or not all(x.isdigit() for x in (*size, head[2])) or not 0 < int(head[2]) < 256:
        return None
    start, n = at + sum(len(x) + 1 for x in head[:3]), int(size[0]) * int(size[1])
    return Found("pgm", at, start + n - at, (start, n), f"{int(size[0])}x{int(size[1])}x8") if 0 < n <= len(b) - start else None


def _au(b: bytes, at: int) -> Found | None:
    if len(b) < at + 24:
        return None
    offset, n, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if offset < 24 or coding not in range(1, 28) or not 0 < channels < 256 or offset + n > len(b) - at:
        return None
    return Found("au", at, offset + n, (at + offset, n) if coding == 2 else None, f"{rate}Hz/{channels}ch/enc{coding}")


def _gif(b: bytes, at: int) -> Found | None:
    if len(b) < at + 13:
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    k = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while k < len(b) and w and h:
        if b[k] == 0x3B:
            return Found("gif", at, k + 1 - at, None, f"{w}x{h}")
        if b[k] == 0x21:
            k += 2
        elif b[k] == 0x2C and k + 10 < len(b):
            k += 11 + (3 << (b[k + 9] & 7) + 1 if b[k + 9] & 128 else 0)
        else:
            return None
        while k < len(b) and b[k]:
            k += 1 + b[k]
        k += 1
    return None


_JPEG_MARK = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
# JPEG markers that begin a frame.
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def _jpeg(b: bytes, at: int) -> Found | None:
    """Segments up to the end mark, with a frame before a scan and each segment as long as it says."""
    k, size, scans = at + 2, "", 0
    while m := _JPEG_MARK.match(b, k):
        mark, k = b[m.end() - 1], m.end()
        if mark == 0xD9:
            return Found("jpeg", at, k - at, None, size) if scans else None
        if mark in (0x01, 0xD8) or k + 2 > len(b):
            return None
        n = struct.unpack_from(">H", b, k)[0]
        if n < 2 or k + n > len(b):
            return None
        if mark in _FRAMES:
            if n < 8 or size:
                return None
            bits, h, w, parts = struct.unpack_from(">BHHB", b, k + 2)
            if bits not in (2, 8, 12, 16) or not w or not 0 < parts < 5 or n != 8 + 3 * parts:
                return None
            size = f"{w}x{h}x{bits * parts}"
        k += n
        if mark == 0xDA:
            if not size or n != 6 + 2 * b[k - n + 2]:
                return None
            scans += 1
            m = _JPEG_MARK.search(b, k)
            if not m:
                return None
            k = m.start()
    return None


def _gzip(b: bytes, at: int) -> Found | None:
    d, k, n = zlib.decompressobj(31), at, 0
    try:
        while not d.eof and k < len(b):
            some, k = b[k : k + DEFLATED], min(len(b), k + DEFLATED)
            while True:  # what comes out is only counted
                got = len(d.decompress(some, INFLATED))
                n, some = n + got, d.unconsumed_tail
                if d.eof or not some and got < INFLATED:
                    break
    except zlib.error:
        return None
    return Found("gzip", at, k - len(d.unused_data) - at, None, f"{n}B") if d.eof else None


class Blob(bytes):
    """Bytes that remember where tokens stand, so that no validator reads on to the end for every place it is tried at."""

    def after(self, token: bytes, at: int, end: int) -> int:
        """The first place of the token from at on that lies before end, or -1."""
        if not hasattr(self, "places"):
            self.places: dict[bytes, list[int]] = {}
        if token not in self.places:
            self.places[token] = [m.start() for m in re.finditer(re.escape(token), self)]
        found = self.places[token]
        k = bisect_left(found, at)
        return found[k] if k < len(found) and found[k] + len(token) <= end else -1


_STARTXREF = re.compile(rb"startxref\s+(\d{1,18})\s+\Z")
_TABLE = re.compile(rb"\s*xref\s+")
_ENTRIES = re.compile(rb"(\d{1,10}) (\d{1,10})[ \r\n]{1,3}")
_OBJECT = re.compile(rb"\s*\d{1,10}\s+\d{1,5}\s+obj\b")
_PREV = re.compile(rb"/Prev\s+(\d{1,18})")
_VERSION = re.compile(rb"%PDF-\d\.\d")


def _pdf_section(b: Blob, s: int, end: int) -> tuple[int, int] | None:
    """Where the dictionary of the cross-reference section at s lies: after a table of 20-byte entries, or in a stream's object."""
    if m := _TABLE.match(b, s, end):
        k = m.end()
        while e := _ENTRIES.match(b, k, end):
            k = e.end() + 20 * int(e[2])
            if k > end:
                return None
        return (k, b.after(b"startxref", k, end)) if k > m.end() and b[k : k + 7] == b"trailer" else None
    return (s, b.after(b"stream", s, end)) if _OBJECT.match(b, s, end) else None


def _pdf_chain(b: Blob, at: int, end: int, known: set[int]) -> list[int] | None:
    """Offsets of the cross-reference sections from the startxref before end along Prev, up to a known one; None if any is none."""
    m = _STARTXREF.search(b, max(at, end - 64), end)
    chain: list[int] = []
    x = int(m[1]) if m else None
    while x is not None and x not in known:
        if x in chain or at + x >= end or not (where := _pdf_section(b, at + x, end)) or where[1] < 0:
            return None
        chain.append(x)
        prev = _PREV.search(b, *where)
        x = int(prev[1]) if prev else None
    return [*chain, x] if x is not None else chain if m else None


def _pdf(b: Blob, at: int) -> Found | None:
    """Up to the first %%EOF, and on to each later one whose sections lead back to those before it. The startxref before it has to
    point at a cross-reference section; or, in a linear file, at none, and then the last startxref has to."""
    end = b.after(b"%%EOF", at, len(b))
    if end < 0 or not _VERSION.match(b, at):
        return None
    first, known = _STARTXREF.search(b, max(at, end - 64), end), set(_pdf_chain(b, at, end, set()) or ())
    linear = first is not None and int(first[1]) == 0  # its first part's sections are reached from the last startxref only
    k = end
    while (known or linear) and (k := b.after(b"%%EOF", k + 5, len(b))) >= 0:
        chain = _pdf_chain(b, at, k, known)
        if chain and max(chain) > end - at and (linear and min(chain) < end - at or chain[-1] in known):
            known, linear, end = known | set(chain), False, k
    return Found("pdf", at, end + 5 - at, None, b[at + 5 : at + 8].decode("latin-1")) if known else None


VALIDATORS = {"wav": _wav, "bmp": _bmp, "png": _png, "pgm": _pgm, "au": _au, "gif": _gif, "jpeg": _jpeg, "gzip": _gzip, "pdf": _pdf}


def automaton():
    """The magic bytes as an Aho-Corasick automaton over Latin-1 text."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, offset, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic), offset, kind))
    a.make_automaton()
    return a


def sniff(blob: bytes, magic) -> list[Found]:
    """Valid files in a blob, outermost first by start; files inside the samples of another are listed too."""
    out, blob = [], Blob(blob)
    for last, (n, offset, kind) in magic.iter(blob.decode("latin-1")):
        at = last + 1 - n - offset
        if at >= 0 and (f := VALIDATORS[kind](blob, at)):
            out.append(f)
    return sorted(out, key=lambda f: (f.start, -f.length))


def read_samples(blob: bytes, f: Found) -> bytes | None:
    """The 8-bit samples of a found file; None if it has none, or not plain ones."""
    if f.payload:
        return blob[f.payload[0] : f.payload[0] + f.payload[1]]
    if f.kind == "png":
        head, data, _ = _png_chunks(blob, f.start)
        w, h, depth, colour, _, _, interlace = head
        if depth != 8 or interlace:
            return None
        step = _PNG_CHANNELS[colour]
        lines = np.frombuffer(zlib.decompress(b"".join(blob[k : k + n] for k, n in data)), np.uint8).reshape(h, step * w + 1)
        out = unfiltered(lines, step)
        return None if out is None else out.tobytes()
    return None


def store_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with media (a file holding the padded UTF-8 bytes as 8-bit samples), declared (a type, wrong for some rows on purpose of
    the format's rotation) and n_bytes. Null counts as empty; equal texts give equal files; same-named columns are replaced; a very
    long text is one file, made by one task; an empty table gives an empty result."""
    session(df)

    @F.arrow_udf("media binary, declared string, n_bytes long")
    def put(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for text in batch.to_pylist():
                payload, n = pad(text)
                c = zlib.crc32(payload)
                rows.append((store(payload, STORED[c % len(STORED)]), STORED[(c >> 8) % len(STORED)], n))
            media, declared, size = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(media, pa.binary()), pa.array(declared, pa.string()), pa.array(size, pa.int64())], ["media", "declared", "n_bytes"])

    return _with_parts(df, put(F.col(text_col)), ("media", "declared", "n_bytes"))


def _with_parts(df: DataFrame, made: Column, names: tuple[str, ...]) -> DataFrame:
    """df with the fields of a struct as columns, in place of its own of the same names."""
    kept, name = without(df, *names), free_name(df)
    return df.withColumn(name, made).select(*[f"`{c}`" for c in kept.columns], *[F.col(f"`{name}`.{c}").alias(c) for c in names])


_CARVED = "array<struct<kind:string,start:long,length:long>>"


def sniff_media(df: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """df with media_type (of the file at the start, null if none is valid), type_ok (declared is right), detail, samples (its 8-bit
    samples; null if it has none, or a depth or an interlacing that isn't read here) and carved (valid files further in). A
    null or empty blob has no type and nothing carved; broken files are no files; a null declared type is never right; an empty
    table gives an empty result; input columns of the same names are replaced."""
    session(df)
    carved = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    @F.arrow_udf(f"media_type string, type_ok boolean, detail string, samples binary, carved {_CARVED}")
    def look(blobs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        magic = automaton()
        for media, declared in blobs:
            cols: list[list] = [[] for _ in range(5)]
            for blob, said in zip(media, declared.to_pylist(), strict=True):
                blob = blob.as_py() or b""
                found = sniff(blob, magic)
                top = found[0] if found and found[0].start == 0 else None
                row = (top and top.kind, top is not None and top.kind == said, top and top.detail, read_samples(blob, top) if top else None, [{"kind": f.kind, "start": f.start, "length": f.length} for f in found if f is not top])
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            types = (pa.string(), pa.bool_(), pa.string(), pa.binary(), carved)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["media_type", "type_ok", "detail", "samples", "carved"])

    own = ("media_type", "type_ok", "detail", "samples", "carved")
    return _with_parts(df, look(F.col(media_col), F.col(declared_col)), own)


def op4_media_sniffing(spark, sf_dir: str) -> DataFrame:
    seen = sniff_media(store_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    n = F.octet_length("samples")
    return seen.select(
        "doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "media_type", "detail", F.when(F.col("type_ok"), "declared right").otherwise(F.concat(F.lit("declared "), "declared")), F.concat(F.lit("carved "), F.array_join(F.transform("carved", lambda c: F.concat_ws("@", c["kind"], c["start"].cast("string"))), ","))).alias("feature"),
    )


QUERIES = {"op4_media_sniffing": op4_media_sniffing}
