"""Media columns: ISO base media containers.

``walk`` finds the nested boxes of a file, ``read_tracks`` decodes the sample
tables of its tracks into codec, duration, sample and keyframe byte ranges; no
payload is decoded. ``store`` lays bytes down as an audio track of 8-bit
samples, in a container of this format, so that they can be read back by their
sample table. Files are read with bounds checks: a box that ends beyond its
parent or a table that ends beyond its box is an error of that file alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliotree.llm.batches import small_batches

# Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
# Audio and video entries of a sample description, and what stands in them before further boxes.
AUDIO, VIDEO = 28, 78
SAMPLE_RATE = 8000
CHUNK = 64  # samples in a chunk of stored bytes
KEY_STEP = 16  # every so many chunks start with a sync sample


class MediaError(ValueError):
    pass


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 < 1 << 32:
        return struct.pack(">I4s", len(data) + 8, kind) + data
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data


def full_box(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def store(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """A container whose only track is ``payload`` as unsigned 8-bit mono samples ('raw ').

    The length must be a positive multiple of 64. The media data stand behind
    the tables, in chunks of 64 samples; the sync samples that start every
    sixteenth chunk are listed as keyframes.
    """
    count = len(payload)
    if not count or count % CHUNK:
        raise MediaError(f"{count} bytes are no positive multiple of {CHUNK}")
    chunk_count = count // CHUNK
    key_chunks = range(0, chunk_count, KEY_STEP)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))

    def moov(base: int) -> bytes:
        large = base + count >= 1 << 32
        offsets = struct.pack(f">{chunk_count}{'Q' if large else 'I'}", *range(base, base + count, CHUNK))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, count, 1)),
            full_box(b"stss", struct.pack(f">I{len(key_chunks)}I", len(key_chunks), *(k * CHUNK + 1 for k in key_chunks))),
            full_box(b"stsc", struct.pack(">IIII", 1, 1, CHUNK, 1)),
            full_box(b"stsz", struct.pack(">II", 1, count)),
            full_box(b"co64" if large else b"stco", struct.pack(">I", chunk_count), offsets),
        )
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, count, 0x55C4, 0), version=1)
        hdlr = full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        tkhd = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, count), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0),
                        matrix, bytes(8), version=1, flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">QQIQIH", 0, 0, rate, count, 0x10000, 0x100), bytes(10), matrix, bytes(24),
                        struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    wide = 8 if count + 8 >= 1 << 32 else 0
    size = len(moov(0))
    base = len(head) + size + 8 + wide
    tables = moov(base)
    if len(tables) != size:  # only where the offsets have just become 64-bit
        base += len(tables) - size
        tables = moov(base)
    return head + tables + box(b"mdat", payload)


def walk(data, start: int = 0, end: int | None = None, path: tuple = ()):
    """Yield (path, body start, body end) of all boxes, parents first, in file order."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise MediaError("cut-off box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise MediaError("cut-off box header")
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise MediaError("a box ends beyond its parent")
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, here)
        start = stop


def _table(data, start: int, end: int, width: int, skip: int = 4) -> tuple:
    """Rows of ``width`` 32-bit numbers behind version, flags, ``skip - 4`` bytes and a count."""
    if end - start < skip + 4:
        raise MediaError("cut-off table")
    count = struct.unpack_from(">I", data, start + skip)[0]
    if start + skip + 4 + 4 * width * count > end:
        raise MediaError("a table ends beyond its box")
    flat = struct.unpack_from(f">{width * count}I", data, start + skip + 4)
    return flat if width == 1 else tuple(zip(*[iter(flat)] * width))


def _ranges(track: dict) -> tuple[list, list]:
    """Byte ranges (first sample, samples, start, end) of the chunks, and of the keyframes."""
    sizes, one, chunk_of, runs = track["sizes"], track["size"], track["offsets"], track["stsc"]
    count = track["samples"]
    out, sample = [], 0
    for at, (first, per_chunk, _) in enumerate(runs):
        last = runs[at + 1][0] if at + 1 < len(runs) else len(chunk_of) + 1
        for chunk in range(first, last):
            if not 1 <= chunk <= len(chunk_of):
                raise MediaError("a chunk is missing")
            n = min(per_chunk, count - sample)
            if n <= 0:
                break
            length = n * one if one else sum(sizes[sample : sample + n])
            begin = chunk_of[chunk - 1]
            if begin + length > track["file_bytes"]:
                raise MediaError("samples end beyond the file")
            out.append((sample, n, begin, begin + length))
            sample += n
    if sample != count:
        raise MediaError("samples without a chunk")
    keys, at = [], 0
    for number in track["sync"] if track["sync"] is not None else ():
        sample = number - 1
        if not 0 <= sample < count:
            raise MediaError("a keyframe is no sample")
        if at and sample < out[at][0]:
            at = 0
        while sample >= out[at][0] + out[at][1]:
            at += 1
        first, _, begin, _ = out[at]
        if one:
            start, size = begin + (sample - first) * one, one
        else:
            start, size = begin + sum(sizes[first:sample]), sizes[sample]
        keys.append((start, start + size))
    return out, keys


def read_tracks(data) -> list[dict]:
    """Of each track: handler, codec, timescale, duration, samples, byte ranges of chunks and keyframes.

    A track without a sync table has only keyframes; they are then not listed one by one (``keyframes`` is None).
    """
    tracks: list[dict] = []
    for path, start, end in walk(data):
        name = path[-1]
        if name == b"trak":
            tracks.append({"sync": None, "stsc": (), "offsets": (), "sizes": (), "size": 0, "samples": 0, "handler": "", "codec": "",
                           "timescale": 0, "duration": 0, "file_bytes": len(data)})
            continue
        if not tracks or b"trak" not in path:
            continue
        track = tracks[-1]
        try:
            if name == b"mdhd":
                wide = data[start] == 1
                track["timescale"], track["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, start + (20 if wide else 12))
            elif name == b"hdlr":
                track["handler"] = bytes(data[start + 8 : start + 12]).decode("latin-1")
            elif name == b"stsd":
                track["codec"] = bytes(data[start + 12 : start + 16]).decode("latin-1")
            elif name == b"stss":
                track["sync"] = _table(data, start, end, 1)
            elif name == b"stsc":
                track["stsc"] = _table(data, start, end, 3)
            elif name == b"stts":
                track["stts"] = _table(data, start, end, 2)
            elif name == b"stsz":
                track["size"], track["samples"] = struct.unpack_from(">II", data, start + 4)
                track["sizes"] = () if track["size"] else _table(data, start, end, 1, skip=8)
            elif name == b"stco":
                track["offsets"] = _table(data, start, end, 1)
            elif name == b"co64":
                track["offsets"] = tuple(a << 32 | b for a, b in zip(*[iter(_table64(data, start, end))] * 2))
        except struct.error:
            raise MediaError("cut-off table") from None
    for track in tracks:
        track["chunks"], keys = _ranges(track)
        track["keyframes"] = None if track["sync"] is None else keys
    return tracks


def _table64(data, start: int, end: int) -> tuple:
    count = struct.unpack_from(">I", data, start + 4)[0]
    if start + 8 + 8 * count > end:
        raise MediaError("a table ends beyond its box")
    return struct.unpack_from(f">{2 * count}I", data, start + 8)


def payload_of(data, track: dict) -> bytes:
    """The stored bytes of a track, by its chunks, in order."""
    out, at = [], None
    for _, _, begin, end in track["chunks"]:
        if out and at == begin:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
        at = end
    return b"".join(bytes(data[a:b]) for a, b in out)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length before."""
    data = (text or "").encode("utf-8")
    return data + bytes(-len(data) % CHUNK if data else CHUNK), len(data)


METADATA = (
    "{id} long, codec string, handler string, timescale long, duration long, samples long, chunks long, "
    "keyframes array<struct<start:long,end:long>>, error string"
)


def metadata(media: DataFrame, id_col: str = "media_id", bytes_col: str = "content") -> DataFrame:
    """One row per track of every container in a binary column; a container without tracks or with an error is one row.

    Columns: the id, ``codec, handler, timescale, duration, samples, chunks,
    keyframes`` (byte ranges; null if all samples are keyframes) and ``error``.
    A null or empty container has the error ``empty``. Repeated rows give
    repeated rows; other columns are not read.
    """
    small_batches(media.sparkSession)
    schema = METADATA.format(id="media_id")

    def run(batches):
        for batch in batches:
            rows = []
            for media_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                blank = {"media_id": media_id}
                view = data.as_buffer() if data.is_valid else b""
                try:
                    if not len(view):
                        raise MediaError("empty")
                    tracks = read_tracks(memoryview(view))
                    rows += [blank | {k: t[k] for k in ("codec", "handler", "timescale", "duration", "samples")}
                             | {"chunks": len(t["chunks"]), "keyframes": None if t["keyframes"] is None else
                                [{"start": a, "end": b} for a, b in t["keyframes"]]} for t in tracks] or [blank | {"error": "no track"}]
                except MediaError as e:
                    rows.append(blank | {"error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_METADATA)

    return media.select(F.col(id_col).cast("long"), F.col(bytes_col)).mapInArrow(run, schema)


_METADATA = pa.schema([
    ("media_id", pa.int64()), ("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()),
    ("samples", pa.int64()), ("chunks", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("error", pa.string()),
])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as containers: ``doc_id, n_bytes, media`` (binary). Null texts are empty; each row is stored for itself."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([store(p) for p, _ in made], pa.large_binary())],
                    schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary")


DIGEST = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
          "media_sha256 string, feature string")


def feature(track: dict) -> str:
    """Codec, clock, duration, counts and the byte ranges of the keyframes, as text."""
    keys = ",".join(f"{a}-{b}" for a, b in track["keyframes"] or ())
    return (f"{track['codec'].strip()};{track['handler']};{track['timescale']};{track['duration']};{track['samples']};"
            f"{len(track['chunks'])};{keys}")


def digests(media: DataFrame) -> DataFrame:
    """From :func:`store_texts`: what is read back of every container. A container that can't be read fails the job."""
    small_batches(media.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n_bytes, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                view = memoryview(data.as_buffer())
                (track,) = read_tracks(view)
                payload = payload_of(view, track)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-CHUNK:]),
                             len(view), hashlib.sha256(view).hexdigest(), feature(track)))
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return media.mapInArrow(run, DIGEST)
