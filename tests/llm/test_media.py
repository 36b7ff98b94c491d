"""ISO media containers: round trips, files of other makers, damaged files."""

import struct
import zlib

import pytest

from foliotree.llm import iso_media as iso
from foliotree.llm.iso_media import box, full_box


def test_round_trip():
    for n in (64, 128, 64 * 17, 64 * 5000):
        payload = bytes(i * 7 % 251 for i in range(n))
        data = iso.store(payload)
        (track,) = iso.read_tracks(data)
        assert iso.payload_of(data, track) == payload
        assert (track["codec"], track["duration"], track["samples"], len(track["chunks"])) == ("raw ", n, n, n // 64)
        assert [data[a] for a, b in track["keyframes"]] == [payload[k] for k in range(0, n, 64 * iso.KEY_STEP)]
    for n in (0, 63):
        with pytest.raises(iso.MediaError):
            iso.store(bytes(n))


def video(sync=True, sizes=(5, 7, 4, 9), per_chunk=((1, 3, 1), (2, 1, 1)), large=True):
    """A track of samples of different sizes in two chunks, the media data first, with 64-bit offsets."""
    body = bytes(range(sum(sizes)))
    head = box(b"ftyp", b"isom") + box(b"mdat", body)
    base = len(box(b"ftyp", b"isom")) + 8
    first = sum(sizes[: per_chunk[0][1]])
    offsets = full_box(b"co64", struct.pack(">IQQ", 2, base, base + first)) if large else full_box(b"stco", struct.pack(">III", 2, base, base + first))
    stbl = box(
        b"stbl", full_box(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full_box(b"stts", struct.pack(">III", 1, 4, 512)),
        full_box(b"stss", struct.pack(">III", 2, 1, 4)) if sync else b"", full_box(b"stsc", struct.pack(">I", 2), *(struct.pack(">III", *r) for r in per_chunk)),
        full_box(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)), offsets)
    mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, 12800, 2048, 0, 0)), full_box(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl))
    return head + box(b"moov", box(b"trak", mdia)) + box(b"free", b"x" * 9), base


def test_sample_tables():
    data, base = video()
    (track,) = iso.read_tracks(data)
    assert (track["codec"], track["handler"], track["timescale"], track["duration"], track["samples"]) == ("avc1", "vide", 12800, 2048, 4)
    assert track["chunks"] == [(0, 3, base, base + 16), (3, 1, base + 16, base + 25)]
    assert track["keyframes"] == [(base, base + 5), (base + 16, base + 25)]
    assert iso.payload_of(data, track) == bytes(range(25))
    assert iso.read_tracks(video(sync=False, large=False)[0])[0]["keyframes"] is None
    assert [p[-1] for p, _, _ in iso.walk(data)][:4] == [b"ftyp", b"mdat", b"moov", b"trak"]


def test_damaged_files_are_errors_of_their_own(spark):
    data, _ = video()
    rows = [(1, data), (2, data[:-20]), (3, None), (4, b""), (5, box(b"ftyp")), (6, data.replace(struct.pack(">II", 0, 4), struct.pack(">II", 0, 400000))),
            (None, data), (1, data), (7, b"\0\0\0\1moov")]
    got = iso.metadata(spark.createDataFrame([(i, b, "e") for i, b in rows], "media_id long, content binary, error string")).collect()
    by = {(r.media_id, r.error) for r in got}
    assert len(got) == len(rows) and (1, None) in by and (None, None) in by
    assert (3, "empty") in by and (4, "empty") in by and (5, "no track") in by
    assert {r.media_id for r in got if r.error} == {2, 3, 4, 5, 6, 7}


def test_texts(spark):
    texts = [(1, "abc", 0), (2, None, 0), (3, "", 0), (4, "é😀" * 5000, 0), (5, "x" * 64, 0), (None, "abc", 0), (1, "abc", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, media int")
    got = iso.digests(iso.store_texts(docs)).collect()
    assert len(got) == len(texts)
    for r, (doc_id, text, _) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(texts, key=lambda t: str(t[0]))):
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.tail_crc32) == (doc_id, len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r.payload_sha256 == __import__("hashlib").sha256(padded).hexdigest() and r.media_bytes > r.payload_bytes
    same = [r for r in got if r.n_bytes == 3]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1
    assert iso.digests(iso.store_texts(docs.limit(0))).count() == 0
