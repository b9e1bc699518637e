"""Media columns: signatures found by Aho-Corasick, confirmed by format validators.

One pass of an Aho-Corasick automaton over a value's bytes gives every place where a known magic number stands. The
format's validator then walks the structure from there (chunk lengths and check sums, box sizes, block chains) and gives
its length, or rejects the place. A confirmed hit at offset 0 that spans the value gives the value's type and corrects the declared one;
the other confirmed hits are carved as embedded media with offset, length and depth, the number of media they lie in. What is read back
from a value is looked through in the same way. Automaton, validators and memory are
per value: nothing grows with the table. What a validator needs from all of a value is gathered once, so a value full of magic numbers
costs no more than about its length.

Texts are stored as media of several kinds (``stored``): 8-bit sound (WAV), 8-bit grey pictures (BMP, PNG), and sound within an archive
(ZIP), which has to be carved to be read. The declared type is right for one half of them.

A null value has no type, no correction and no embedded media; an empty value is ``application/octet-stream``. Equal values are treated alike, and so
are repeated rows. An empty table gives an empty one. Other columns stay, but for those that a function sets.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import table

UNKNOWN = "application/octet-stream"
RATE = 8000
UNIT = 192
CARVED_DEPTH = 16  # media of one depth don't overlap, so what is carved of a value is at most so many times its length


@lru_cache(maxsize=8)
def _places(b: bytes, mark: bytes) -> np.ndarray:
    """Where a mark stands; kept, as every hit of a value asks for the same."""
    return np.array([m.start() for m in re.finditer(re.escape(mark), b)], np.int64)


def _png(b: bytes, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, pos)
        kind, end = b[pos + 4 : pos + 8], pos + 12 + n
        if end > len(b) or (first and kind != b"IHDR") or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        pos, first = end, False
    return 0


@lru_cache(maxsize=2)
def _gif_ends(b: bytes) -> tuple[dict[int, int], dict[int, int]]:
    """Of places in a value, where a chain of sub-blocks and where a picture's blocks end from there (0: nowhere). Filled as hits ask; walks that meet share
    what is known, so all hits together read each place once."""
    return {}, {}


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    chains, ends = _gif_ends(b)

    def blocks(p: int) -> int:
        walked = []
        while p < len(b) and p not in chains:
            walked.append(p)
            if not b[p]:
                chains[p] = p + 1
                break
            p += 1 + b[p]
        end = chains.get(p, len(b) + 1)
        chains.update(dict.fromkeys(walked, end))
        return end

    walked, end = [], 0
    while pos < len(b) and pos not in ends:
        walked.append(pos)
        if b[pos] == 0x3B:
            end = pos + 1
            break
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
        else:
            break
    end = ends.get(pos, end)
    ends.update(dict.fromkeys(walked, end))
    return end - at if end else 0


def _jpeg(b: bytes, at: int) -> int:
    pos, frame = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind = b[pos + 1]
        (n,) = struct.unpack_from(">H", b, pos + 2)
        if n < 2 or pos + 2 + n > len(b):
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if kind == 0xDA:
            if not frame:
                return 0
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):  # to the next marker after entropy-coded data
                if b[pos + 1] == 0xD9:
                    return pos + 2 - at
                if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7 and b[pos + 1] != 0xFF:
                    break
                pos += 2 if b[pos + 1] != 0xFF else 1
            else:
                return 0
    return 0


def _riff(form: bytes) -> Callable[[bytes, int], int]:
    def walk(b: bytes, at: int) -> int:
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return 0
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        pos, seen = at + 12, set()
        if end > len(b):
            return 0
        while pos + 8 <= end:
            n = struct.unpack_from("<I", b, pos + 4)[0]
            seen.add(b[pos : pos + 4])
            pos += 8 + n + (n & 1)
        need = {b"fmt ", b"data"} if form == b"WAVE" else {b"VP8 ", b"VP8L", b"VP8X"}
        return end - at if pos == end and (need <= seen if form == b"WAVE" else need & seen) else 0

    return walk


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, offset, header, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    fits = 26 < offset <= size and at + size <= len(b) and header in (40, 52, 56, 108, 124)
    return size if fits and not zero and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and w > 0 and h else 0


@lru_cache(maxsize=2)
def _trailers(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of PDF trailers with their startxref's place and number, and the places where a cross-reference may stand."""
    out = []
    for end in _places(b, b"%%EOF").tolist():
        ref = b.rfind(b"startxref", max(0, end - 64), end)
        said = b[ref + 9 : end].split() if ref >= 0 else []
        if len(said) == 1 and said[0].isdigit() and len(said[0]) < 19:
            out.append((end, ref, int(said[0])))
    tables = np.zeros(len(b) + 1, bool)
    tables[[m.start() for m in re.finditer(rb"xref|(?=[0-9]{1,10}\s+[0-9]{1,5}\s+obj)", b)]] = True
    end, ref, number = np.array(out, np.int64).reshape(-1, 3).T
    return end, ref, number, tables


@lru_cache(maxsize=2)
def _last_trailers(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End, place and number of the last trailer of each number, the last first."""
    end, ref, number, _ = _trailers(b)
    _, last = np.unique(number[::-1], return_index=True)
    keep = np.sort(len(number) - 1 - last)[::-1]
    keep = keep[number[keep] > 0]
    return end[keep], ref[keep], number[keep]


CHUNK = 512


@lru_cache(maxsize=2)
def _surplus(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of every end of a PDF how many more PDFs begin than end before it, and the least of each ``CHUNK`` of them."""
    ends, inner = _places(b, b"%%EOF"), _places(b, b"%PDF-")
    more = np.searchsorted(inner, ends) - np.arange(len(ends))
    return more, np.minimum.reduceat(more, np.arange(0, len(more), CHUNK)) if len(more) else more


def _first_at_most(b: bytes, start: int, most: int) -> int:
    """The first end from ``start`` on with a surplus of at most ``most``; ``start`` if there is none."""
    more, least = _surplus(b)
    part = (start // CHUNK + 1) * CHUNK
    near = np.flatnonzero(more[start:part] <= most)
    if len(near):
        return start + int(near[0])
    far = np.flatnonzero(least[part // CHUNK :] <= most)
    if not len(far):
        return start
    part += int(far[0]) * CHUNK
    return part + int(np.flatnonzero(more[part : part + CHUNK] <= most)[0])


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return 0
    # Its own trailers are those whose startxref leads to a cross-reference table or stream, counted from its own beginning.
    tables = _trailers(b)[3]
    end, ref, number = _last_trailers(b)
    to = at + number
    own = np.flatnonzero((ref >= at) & (to < ref) & tables[np.minimum(to, len(b))])
    if len(own):
        return int(end[own[0]]) + 5 - at
    # Where no offset holds: the first end that isn't that of a PDF within.
    refs, ends, inner = _places(b, b"startxref"), _places(b, b"%%EOF"), _places(b, b"%PDF-")
    k = bisect_left(refs, at)
    first = bisect_left(ends, refs[k]) if k < len(refs) else len(ends)
    if first == len(ends):
        return 0
    return int(ends[_first_at_most(b, first, bisect_left(inner, at + 1) - first)]) + 5 - at


@lru_cache(maxsize=2)
def _archives(b: bytes) -> dict[int, int]:
    """Where a ZIP archive begins and ends, from the records at their ends; of several the first."""
    out: dict[int, int] = {}
    for end in _places(b, b"PK\x05\x06").tolist():
        if end + 22 <= len(b):
            n, size, offset, comment = struct.unpack_from("<HIIH", b, end + 10)
            at = end - size - offset
            if at >= 0 and end + 22 + comment <= len(b) and (not n or b[at + offset : at + offset + 4] == b"PK\x01\x02"):
                out.setdefault(at, end + 22 + comment)
    return out


def _zip(b: bytes, at: int) -> int:
    return _archives(b).get(at, at) - at


def _pages(b: bytes, at: int) -> list[tuple[int, int]]:
    """Begin and end of the Ogg pages up to the end of all streams begun; nothing if the last is cut off."""
    pos, open_, out = at, set(), []
    while pos + 27 <= len(b) and b[pos : pos + 5] == b"OggS\x00":
        n = b[pos + 26]
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if end > len(b):
            return []
        flags, stream = b[pos + 5], b[pos + 14 : pos + 18]
        if flags & 2 or not out:
            open_.add(stream)
        if flags & 4:
            open_.discard(stream)
        out.append((pos, end))
        pos = end
        if not open_:
            break
    return out


def _ogg(b: bytes, at: int) -> int:
    pages = _pages(b, at)
    return pages[-1][1] - at if pages else 0


def _mp4(b: bytes, at: int) -> int:
    pos, kinds = at - 4, []
    while pos >= 0 and pos + 8 <= len(b):
        n, kind = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        if n == 1 and pos + 16 <= len(b):
            (n,) = struct.unpack_from(">Q", b, pos + 8)
        if n < 8 or pos + n > len(b) or not kind.isalnum() or (kind in (b"ftyp", b"moov") and kind in kinds):  # a second one is another file's
            break
        kinds.append(kind)
        pos += n
    return pos - (at - 4) if b"ftyp" in kinds[:1] and b"moov" in kinds else 0


#: Magic number, type, bytes before the magic number, validator. Fixed values.
FORMATS: tuple[tuple[bytes, str, int, Callable[[bytes, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", 0, _png),
    (b"GIF87a", "image/gif", 0, _gif),
    (b"GIF89a", "image/gif", 0, _gif),
    (b"\xff\xd8\xff", "image/jpeg", 0, _jpeg),
    (b"RIFF", "audio/wav", 0, _riff(b"WAVE")),
    (b"RIFF", "image/webp", 0, _riff(b"WEBP")),
    (b"BM", "image/bmp", 0, _bmp),
    (b"%PDF-", "application/pdf", 0, _pdf),
    (b"PK\x03\x04", "application/zip", 0, _zip),
    (b"OggS\x00", "audio/ogg", 0, _ogg),
    (b"ftyp", "video/mp4", 4, _mp4),
)


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, *_ in FORMATS:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(found, value: bytes) -> list[tuple[int, int, str, int]]:
    """Offset, length, type and depth (how many others it begins in) of every confirmed medium, in order of offset. Of those of one type with one end only the first counts."""
    hits: list[tuple[int, int, str]] = []
    pages: set[int] = set()
    for last, magic in found.iter(value.decode("latin-1")):
        at = last + 1 - len(magic)
        if at in pages:
            continue  # a later page of a stream that is known
        for own, kind, before, check in FORMATS:
            if own == magic and (n := check(value, at)):
                hits.append((at - before, n, kind))
                if kind == "audio/ogg":
                    pages.update(p for p, _ in _pages(value, at))
                break
    out, ends, seen = [], [], set()
    for at, n, kind in sorted(hits, key=lambda h: (h[0], -h[1])):
        if (kind, at + n) in seen:
            continue  # the tail of a medium that began before
        seen.add((kind, at + n))
        while ends and ends[-1] <= at:
            ends.pop()
        out.append((at, n, kind, len(ends)))
        insort(ends, at + n, key=lambda e: -e)  # the next to end stands last
    return out


def looked(found, value: bytes | None) -> tuple[str | None, list[dict] | None]:
    """Type of a value and what is embedded in it. Media deeper than ``CARVED_DEPTH`` others have no bytes of their own, as those are within theirs."""
    if value is None:
        return None, None
    hits = sniff(found, value)
    top = hits[0] if hits and hits[0][:2] == (0, len(value)) else None
    return top[2] if top else UNKNOWN, [{"offset": o, "length": n, "kind": k, "bytes": value[o : o + n] if d < CARVED_DEPTH else None, "depth": d} for o, n, k, d in hits if (o, n, k, d) != top]


EMBEDDED = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("bytes", T.BinaryType()), T.StructField("depth", T.IntegerType())]))
_CARVED = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("bytes", pa.binary()), ("depth", pa.int32())]))


def inspect(media: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """Adds detected (type), corrected (whether it differs from the declared one) and embedded (what else was carved)."""
    keep = media.drop("detected", "corrected", "embedded")
    schema = T.StructType([*keep.schema.fields, T.StructField("detected", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("embedded", EMBEDDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                kinds, wrong, carved = [], [], []
                for value, said in zip(b.column(content), b.column(declared).to_pylist(), strict=True):
                    kind, inside = looked(found, value.as_py())
                    kinds.append(kind)
                    wrong.append(None if kind is None else kind != said)
                    carved.append(inside)
                extra = pa.array(carved, _CARVED)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), extra], names=schema.names)

    return keep.mapInArrow(run, schema)


def wav_of(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono samples."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\x00" * pad


def bmp_of(payload: bytes) -> bytes:
    """The payload as a picture of 8-bit grey samples, ``UNIT`` to a row."""
    rows = len(payload) // UNIT
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + len(payload), 0, 1078, 40, UNIT, rows, 1, 8, 0, len(payload), 0, 0, 256, 0)
    grey = bytes(x for k in range(256) for x in (k, k, k, 0))
    return head + grey + np.frombuffer(payload, np.uint8).reshape(rows, UNIT)[::-1].tobytes()


def png_of(payload: bytes) -> bytes:
    """The payload as a picture of 8-bit grey samples, ``UNIT`` to a row, each after filter 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 1)) + chunk(b"IEND", b"")


def zip_of(content: bytes, name: bytes = b"sound.wav") -> bytes:
    """An archive with one member, not compressed."""
    own = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, zlib.crc32(content), len(content), len(content), len(name), 0)
    local = b"PK\x03\x04" + own + name + content
    central = b"PK\x01\x02" + struct.pack("<H", 20) + own + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name
    return local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)


def samples_of(content: bytes, kind: str) -> bytes | None:
    """The 8-bit samples of a WAV file, or of a grey picture as it is written here; nothing of others."""
    if kind == "audio/wav":
        pos = 12
        while pos + 8 <= len(content):
            n = struct.unpack_from("<I", content, pos + 4)[0]
            if content[pos : pos + 4] == b"data":
                return content[pos + 8 : pos + 8 + n]
            pos += 8 + n + (n & 1)
    elif kind == "image/bmp":
        offset, _, wide, high, _, bits, packed = struct.unpack_from("<IIiiHHI", content, 10)
        if bits == 8 and not packed and wide > 0 and wide % 4 == 0 and high > 0 and offset + wide * high <= len(content):
            return np.frombuffer(content, np.uint8, wide * high, offset).reshape(high, wide)[::-1].tobytes()
    elif kind == "image/png":
        pos, data, size = 8, [], None
        while pos + 12 <= len(content):
            (n,) = struct.unpack_from(">I", content, pos)
            part = content[pos + 8 : pos + 8 + n]
            if content[pos + 4 : pos + 8] == b"IHDR":
                size = struct.unpack(">IIBBBBB", part)
            elif content[pos + 4 : pos + 8] == b"IDAT":
                data.append(part)
            pos += 12 + n
        if size and size[2:] == (8, 0, 0, 0, 0):
            raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
            if len(raw) == size[1] * (size[0] + 1) and not (rows := raw.reshape(size[1], size[0] + 1))[:, 0].any():
                return rows[:, 1:].tobytes()
    return None


#: How a text is stored, by its check sum: the stored type, and how its payload is written.
FORMS: tuple[tuple[str, Callable[[bytes], bytes]], ...] = (("audio/wav", wav_of), ("image/bmp", bmp_of), ("image/png", png_of), ("application/zip", lambda payload: zip_of(wav_of(payload))))


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes, content (a text's bytes, padded with blanks, as a medium of one of ``FORMS``) and declared (its type, or a wrong one)."""
    keep = docs.drop("n_bytes", "content", "declared")
    schema = T.StructType([*keep.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("declared", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                raw = [(x.as_py() or "").encode() for x in b.column(text)]
                contents, said = [], []
                for x in raw:
                    payload = x + b" " * (-len(x) % UNIT if x else UNIT)
                    pick = zlib.crc32(payload)
                    kind, write = FORMS[pick % len(FORMS)]
                    contents.append(write(payload))
                    said.append(kind if pick // len(FORMS) % 2 else "image/jpeg")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in raw], pa.int64()), pa.array(contents, pa.binary()), pa.array(said, pa.string())], names=schema.names)

    return keep.mapInArrow(run, schema)


def read_back(media: DataFrame, content: str = "content") -> DataFrame:
    """Adds payload: the samples of the values that hold some, else of the first medium in them that does, else null; what the payload is and holds itself
    (payload_detected, payload_embedded), without the padding if there is n_bytes; and payload_mean, the mean of its samples."""
    keep = media.drop("payload", "payload_detected", "payload_embedded", "payload_mean")
    sized = "n_bytes" in keep.columns
    more = [T.StructField("payload", T.BinaryType()), T.StructField("payload_detected", T.StringType()), T.StructField("payload_embedded", EMBEDDED), T.StructField("payload_mean", T.DoubleType())]
    schema = T.StructType([*keep.schema.fields, *more])

    def samples(value: bytes, kind: str | None, inside: list[dict] | None) -> bytes | None:
        parts = [(value, kind), *((x["bytes"], x["kind"]) for x in inside or () if x["bytes"] is not None)]
        return next((got for part, own in parts if own and (got := samples_of(part, own)) is not None), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out = [samples(v.as_py(), k.as_py(), e.as_py()) for v, k, e in zip(b.column(content), b.column("detected"), b.column("embedded"), strict=True)]
                sizes = b.column("n_bytes").to_pylist() if sized else [None] * len(out)
                kinds, carved = zip(*[looked(found, p if p is None or n is None else p[:n]) for p, n in zip(out, sizes, strict=True)], strict=True)
                mean = [float(np.frombuffer(p, np.uint8).mean()) if p else None for p in out]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary()), pa.array(kinds, pa.string()), pa.array(carved, _CARVED), pa.array(mean, pa.float64())], names=schema.names)

    return keep.mapInArrow(run, schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = read_back(inspect(stored(docs).drop("text")))
    p = F.col("payload")
    tail = F.substring(p, F.length(p) - 15, F.lit(16))
    kinds = F.array_join(F.transform("embedded", lambda e: F.concat_ws("@", e["kind"], e["offset"].cast("string"))), "+")
    return seen.select(
        "doc_id",
        "n_bytes",
        F.length(p).cast("long").alias("payload_bytes"),
        F.sha2(p, 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("content").cast("long").alias("media_bytes"),
        F.sha2("content", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("detected"), F.when(F.col("corrected"), "corrected").otherwise("as declared"), F.concat(F.lit("embedded="), kinds), F.concat(F.lit("payload="), F.col("payload_detected")), F.concat(F.lit("mean="), F.format_number("payload_mean", 3))).alias("feature"),
    )
