"""Operator 4, media columns in Ogg.

A payload of 8-bit samples is stored as one physical Ogg stream of two
multiplexed logical streams: samples (an own "pcm8" mapping, granule position =
samples so far) and marks (one packet with the unpadded length). Reading back
verifies every page's checksum and the first and last page's flags, reassembles
packets from lacing values, also across pages, demultiplexes the logical streams by
serial number and derives timestamps from granule positions: a page's position is
the end of the last packet that ends in it, and those before end earlier by the
durations (samples) of the packets that follow them.

Rows: a null text is an empty one; its payload is 64 zero bytes. Equal texts
give equal bytes. Media that is null, cut or damaged never fails the job: bad
pages are counted and skipped, packets that miss a part are dropped, and `ok`
is false. Any other columns are left alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import small_batches, table

RATE = 8_000
PACKET = 4_000
SAMPLES, MARKS = 1, 2
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04c11db7, not reflected, from 0. zlib's is the reflected one, so bits are mirrored on both sides."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, kind, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """packets: with the granule position at the end of each. The first packet has a page of its own."""
    number, lacing, body, granule, carried = 0, bytearray(), bytearray(), -1, False
    for n, (packet, end) in enumerate(packets):
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for k, size in enumerate(sizes):
            if len(lacing) == 255:
                yield _page(_CONTINUED * carried, granule, serial, number, bytes(lacing), bytes(body))
                number, lacing, body, granule, carried = number + 1, bytearray(), bytearray(), -1, k > 0
            lacing.append(size)
            body += packet[at : at + size]
            at += size
        granule = end
        if n == 0 or n == len(packets) - 1:
            kind = _CONTINUED * carried | _FIRST * (n == 0) | _LAST * (n == len(packets) - 1)
            yield _page(kind, granule, serial, number, bytes(lacing), bytes(body))
            number, lacing, body, granule, carried = number + 1, bytearray(), bytearray(), -1, False


def write_ogg(payload: bytes, n_bytes: int) -> bytes:
    parts = [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    samples = list(_pages(SAMPLES, [(struct.pack("<4sII", b"pcm8", RATE, 1), 0), *parts]))
    marks = list(_pages(MARKS, [(b"mark", 0), (struct.pack("<Q", n_bytes), len(payload))]))
    return b"".join([samples[0], marks[0], *samples[1:-1], marks[1], samples[-1]])


def _duration(packets: list[tuple[bytes, float]], k: int) -> int:
    """Samples of a stream's packet: one a byte in a stream of samples, none in its header and in other streams."""
    return len(packets[k][0]) if k and packets[0][0].startswith(b"pcm8") else 0


def read_ogg(media: bytes | None) -> dict:
    """Pages, bad pages, and of each serial number its packets with the seconds at which they end."""
    media = media or b""
    out = {"pages": 0, "bad": 0, "streams": {}}
    state: dict[int, tuple[int, list[bytes] | None]] = {}
    ended: set[int] = set()
    at = media.find(b"OggS")
    skipped = at != 0
    while at >= 0:
        head = media[at : at + 27]
        n = head[26] if len(head) == 27 else 0
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        good = len(head) == 27 and len(lacing) == n and len(page) == end - at and head[4] == 0
        good = good and checksum(page[:22] + bytes(4) + page[26:]) == struct.unpack_from("<I", head, 22)[0]
        if not good:
            out["bad"] += 1
            at = media.find(b"OggS", at + 4)
            continue
        _, _, kind, granule, serial, number, _ = struct.unpack("<4sBBqIII", head[:26])
        out["pages"] += 1
        last, open_ = state.get(serial, (-1, None))
        # a stream begins with a page that says so, and nothing follows the page that ends it
        skipped |= bool(kind & _FIRST) != (serial not in state) or serial in ended
        if kind & _LAST:
            ended.add(serial)
        if number != last + 1 or not kind & _CONTINUED:
            skipped |= number != last + 1 or open_ is not None
            open_ = None
        packets = out["streams"].setdefault(serial, [])
        place, whole = 27 + n, not kind & _CONTINUED or open_ is not None
        part = open_ if kind & _CONTINUED and open_ is not None else []
        size, here = 0, len(packets)
        for k, value in enumerate(lacing):
            size += value
            if value < 255 or k == n - 1:
                part.append(page[place : place + size])
                place, size = place + size, 0
                if value < 255:
                    if whole:
                        packets.append((b"".join(part), 0.0))
                    part, whole = [], True
        end_of = granule
        for k in range(len(packets) - 1, here - 1, -1):
            packets[k] = (packets[k][0], max(0, end_of) / RATE)
            end_of -= _duration(packets, k)
        state[serial] = (number, part if n and lacing[-1] == 255 and whole else None)
        following = media.find(b"OggS", end)
        skipped |= following not in (end, -1) or following == -1 and end < len(media)
        at = following
    out["ok"] = bool(media) and not skipped and not out["bad"] and ended == set(state) and all(x[1] is None for x in state.values())
    return out


def _described(media: bytes | None) -> dict:
    """Payload and figures of one stored stream."""
    found = read_ogg(media)
    samples, marks = found["streams"].get(SAMPLES, []), found["streams"].get(MARKS, [])
    payload = b"".join(p for p, _ in samples[1:])
    n_bytes = struct.unpack("<Q", marks[1][0])[0] if len(marks) > 1 and len(marks[1][0]) == 8 else None
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    seconds = samples[-1][1] if samples else 0.0
    mean = float(x.mean(dtype=np.float64)) if x.size else 0.0
    rms = float(np.sqrt(np.square(x).mean(dtype=np.float64))) if x.size else 0.0
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    feature = f"pages={found['pages']};bad={found['bad']};streams={len(found['streams'])};packets={len(samples) + len(marks)};seconds={seconds:.6f};mean={mean:.6f};rms={rms:.6f};crossings={crossings}"
    return {
        "ok": found["ok"] and n_bytes is not None and n_bytes <= len(payload),
        "n_bytes": n_bytes,
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media or b""),
        "media_sha256": hashlib.sha256(media or b"").hexdigest(),
        "feature": feature,
        "times": [t for _, t in samples],
    }


_DESCRIBED = [("ok", "boolean", pa.bool_()), ("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("times", "array<double>", pa.list_(pa.float64()))]


def encode_text(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary): each whole text as samples."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([write_ogg(padded(r), len(r)) for r in raw], pa.binary())], names=["doc_id", "media"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """doc_id and, read back from the bytes of media: payload digests, figures and packet times."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [_described(x.as_buffer().to_pybytes() if x.is_valid else None) for x in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([f[n] for f in found], kind) for n, _, kind in _DESCRIBED)], names=["doc_id", *(n for n, _, _ in _DESCRIBED)])

    narrow = media.select("doc_id", "media")
    schema = ", ".join([f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}", *(f"{n} {kind}" for n, kind, _ in _DESCRIBED)])
    return narrow.mapInArrow(run, schema)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = describe_media(encode_text(table(spark, sf_dir, "documents")))
    return read_back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "ok")
