import hashlib
import random
import zlib

from helpers import DOCS, documents

from lodestitch.llm import media


def _slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(3)
    for n in (0, 1, 7, 300):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert media.checksum(data) == _slow_crc(data)


def test_round_trip(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "z" * 4000, "w" * 255 * 300 + "ñ", "long " * 200_000, "a"]
    docs = documents(spark, texts).withColumnRenamed("source", "media")
    got = {r.doc_id: r for r in media.describe_media(media.encode_text(docs)).collect()}
    for n, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[n]
        assert (r.ok, r.n_bytes, r.payload_bytes) == (True, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        ogg = media.write_ogg(payload, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(ogg), hashlib.sha256(ogg).hexdigest())
        assert r.times == sorted(r.times) and r.times[-1] == len(payload) / media.RATE
    assert got[2].feature == got[9].feature


def test_pages_follow_the_format():
    ogg = media.write_ogg(bytes(range(256)) * 400, 5)
    at, seen = 0, {}
    while at < len(ogg):
        assert ogg[at : at + 4] == b"OggS"
        n = ogg[at + 26]
        serial = int.from_bytes(ogg[at + 14 : at + 18], "little")
        assert int.from_bytes(ogg[at + 18 : at + 22], "little") == seen.get(serial, -1) + 1
        seen[serial] = seen.get(serial, -1) + 1
        at += 27 + n + sum(ogg[at + 27 : at + 27 + n])
    assert seen[media.SAMPLES] > 1 and seen[media.MARKS] == 1
    found = media.read_ogg(ogg)
    assert found["ok"] and b"".join(p for p, _ in found["streams"][media.SAMPLES][1:]) == bytes(range(256)) * 400


def test_packet_times():
    payload = bytes(40_000)
    times = [t for _, t in media.read_ogg(media.write_ogg(payload, 40_000))["streams"][media.SAMPLES]]
    assert times == [0.0, *(min(40_000, k) / media.RATE for k in range(media.PACKET, 40_000 + media.PACKET, media.PACKET))]
    odd = media.write_ogg(bytes(64 * 1000 + 64), 5)
    times = [t for _, t in media.read_ogg(odd)["streams"][media.SAMPLES]]
    assert times[1:] == [min(64_064, k) / media.RATE for k in range(media.PACKET, 64_064 + media.PACKET, media.PACKET)]


def test_first_and_last_flags_are_verified():
    good = media.write_ogg(bytes(20_000), 9)

    def with_kind(at, change):
        n = good[at + 26]
        end = at + 27 + n + sum(good[at + 27 : at + 27 + n])
        page = bytearray(good[at:end])
        page[5] ^= change
        page[22:26] = bytes(4)
        page[22:26] = media.checksum(bytes(page)).to_bytes(4, "little")
        return good[:at] + bytes(page) + good[end:]

    last = good.rindex(b"OggS")
    assert media.read_ogg(good)["ok"] and not media.read_ogg(with_kind(0, 2))["ok"] and not media.read_ogg(with_kind(last, 4))["ok"] and not media.read_ogg(with_kind(last, 2))["ok"]


def test_damage_is_found(spark):
    good = media.write_ogg(bytes(200_000), 9)
    rows = [(1, good), (2, None), (3, b""), (4, b"no pages"), (5, good[:-10]), (6, good[:5000] + b"!" + good[5001:]), (7, b"junk" + good), (8, good[100:])]
    got = {r.doc_id: r for r in media.describe_media(spark.createDataFrame([(n, bytearray(m) if m is not None else None) for n, m in rows], "doc_id bigint, media binary")).collect()}
    assert got[1].ok and not any(got[n].ok for n in range(2, 9))
    assert got[6].payload_bytes < 200_000 and got[7].payload_bytes == 200_000
    assert media.encode_text(spark.createDataFrame([], DOCS)).count() == 0
