import hashlib
import random
import zlib

import pytest
from fixtures import AWKWARD, documents, saved
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import media


def only(s):
    return s.payload[media.STREAM_PID]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 45_000), st.integers(0, 9))
def test_any_payload_round_trips(size, seed):
    raw = random.Random(seed).randbytes(size)
    payload = media.payload_of(raw)
    data, access = media.mux(payload)
    s = media.demux(data)
    assert len(data) % media.PACKET == 0 and len(payload) % media.FRAME == 0 and payload.startswith(raw)
    assert only(s) == payload
    assert (s.continuity_errors, s.packet_errors, s.table_errors, s.repeated) == (0, 0, 0, 0)
    assert s.programs == {1: media.MAP_PID} and s.streams == {media.STREAM_PID: media.STREAM_TYPE}
    assert [u[1] for u in s.units] == [k * media.FRAMES * media.TICKS for k in range(len(s.units))]
    assert [u[1] for u in s.units if u[3]] == [p for p, _ in access] == s.clocks


def test_a_reader_can_begin_at_an_access_point():
    payload = media.payload_of(random.Random(1).randbytes(200_000))
    data, access = media.mux(payload)
    pts, packet = access[3]
    s = media.demux(data[packet * media.PACKET :])
    assert s.units[0][1] == pts and payload.endswith(only(s)) and s.continuity_errors == 0


def test_lost_repeated_and_broken_packets_are_counted():
    payload = media.payload_of(random.Random(2).randbytes(20_000))
    data, _ = media.mux(payload)
    rows = [data[i : i + 188] for i in range(0, len(data), 188)]
    assert media.demux(b"".join(rows[:5] + rows[6:])).continuity_errors == 1
    twice = media.demux(b"".join(rows[:6] + [rows[5]] + rows[6:]))
    assert (twice.repeated, twice.continuity_errors) == (1, 0) and only(twice) == payload
    broken = bytearray(rows[0])
    broken[14] ^= 1
    s = media.demux(bytes(broken) + b"".join(rows[1:]))
    assert s.table_errors == 1 and s.programs == {}
    noise = media.demux(b"\x00" * 188 + b"".join(rows) + b"\x47")
    assert noise.packet_errors == 2 and only(noise) == payload
    assert media.demux(b"").packets == 0


def test_long_times_survive():
    for pts in (0, 1, 2**33 - 1, 0x1_2345_6789):
        pes = b"\x00\x00\x01\xbd\x00\x00\x80\x80\x05" + media._stamp(pts)
        assert media._time(pes) == pts


def test_table_checksum_of_a_known_value():
    assert media.table_checksum(b"123456789") == 0x0376E6E7


def test_query(spark, tmp_path):
    texts = AWKWARD + ["é" * 288, "x" * 576, "x" * 577, "same", "same"]
    got = {r.doc_id: r for r in media.query(spark, saved(spark, tmp_path, documents(spark, texts))).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        stream = media.mux(payload)[0]
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
    assert tuple(got[len(texts) - 1])[1:] == tuple(got[len(texts) - 2])[1:]


def test_empty_table(spark):
    assert media.parsed(media.media(documents(spark, ["x"]).limit(0))).count() == 0


@pytest.mark.parametrize("n", [175, 176, 177, 183, 184, 185])
def test_packets_of_odd_sizes(n):
    packet = media._packet(b"z" * min(n, 184), True, 3)
    assert len(packet) == 188
