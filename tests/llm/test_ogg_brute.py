"""Operator 7 against an independent reader and the texts themselves."""

import hashlib
import struct
import zlib

import numpy as np

from fathomgrid.llm import ogg

from .test_edges import ROWS, docs  # noqa: F401


def packets_of(data):
    """serial: packets and the ends of those that a page tells, straight from the format's description."""
    out, at = {}, 0
    while at < len(data):
        assert data[at : at + 4] == b"OggS" and data[at + 4] == 0
        granule, serial = struct.unpack_from("<qI", data, at + 6)
        table = data[at + 27 : at + 27 + data[at + 26]]
        body = at + 27 + len(table)
        s = out.setdefault(serial, [[], b"", {}])
        for v in table:
            s[1] += data[body : body + v]
            body += v
            if v < 255:
                s[0].append(s[1])
                s[1] = b""
        if granule >= 0:
            s[2][len(s[0]) - 1] = granule
        at = body
    assert all(not s[1] for s in out.values())
    return out


def payload(media):
    channels = {}
    for packets, _, ends in packets_of(media).values():
        assert packets[0][:4] == b"PCM8"
        own = b"".join(packets[1:])
        for k, end in ends.items():
            assert end == (0 if k == 0 else sum(map(len, packets[1 : k + 1])))
        channels[packets[0][5]] = np.frombuffer(own, np.uint8)
    return np.stack([channels[c] for c in sorted(channels)], 1).tobytes()


def test_digest_of_every_text(spark, docs):  # noqa: F811
    got = sorted((tuple(r[c] for c in ("doc_id", "_n_bytes", "_payload_bytes", "_payload_sha256", "_tail_crc32")) for r in ogg.store_documents(docs).collect()), key=repr)
    want = []
    for i, t, *_ in ROWS:
        own = (t or "").encode()
        p = own + b" " * (-len(own) % 192 or (0 if own else 192))
        want.append((i, len(own), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want, key=repr)


def test_media_read_by_another_reader(spark, docs):  # noqa: F811
    by = {}
    for r in ogg.store_documents(docs).collect():
        media = bytes(r._media)
        assert r._media_bytes == len(media) and r._media_sha256 == hashlib.sha256(media).hexdigest()
        p = payload(media)
        assert hashlib.sha256(p).hexdigest() == r._payload_sha256
        x = np.frombuffer(p, np.uint8).reshape(-1, 2).astype(float)
        f = dict(kv.split("=") for kv in r._feature.split(";"))
        assert np.allclose([float(v) for v in f["mean"].split(",")], x.mean(0), atol=1e-3)
        assert np.allclose([float(v) for v in f["rms"].split(",")], np.sqrt((x * x).mean(0)), atol=1e-3)
        assert by.setdefault(p, (r._media_sha256, r._feature)) == (r._media_sha256, r._feature)


def test_times_of_all_packets():
    packets = [(b"head", 0), *((bytes([k]) * 100, 100 * (k + 1)) for k in range(7))]
    s = ogg.demultiplex(b"".join(ogg.paged(packets, 5)))[5]
    assert s.times(100).count(None) == 6
    assert s.times(100, len)[1:] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
