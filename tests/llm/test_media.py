import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import media


def test_payload_and_wav_round_trip():
    for text, size in (("", 64), ("a", 64), ("a" * 64, 64), ("é" * 33, 128)):
        payload = media.payload_of(text)
        assert len(payload) == size and payload.rstrip(b"\0") == text.encode()
        with wave.open(io.BytesIO(media.to_wav(payload))) as w:
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == payload
        assert media.from_wav(media.to_wav(payload)) == payload


def cuts_by_hand(data):
    g, h, ends, start = media.gear().tolist(), 0, [], 0
    for i, b in enumerate(data):
        if len(data) - start <= media.LEAST_CHUNK:
            break
        h = ((h << 1) + g[b]) & 0xFFFFFFFF
        n = i + 1 - start
        if n >= media.LEAST_CHUNK and h >> (32 - media.CUT_BITS) == 0 or n == media.MOST_CHUNK:
            ends.append(start := i + 1)
    return ends + [len(data)] * (not ends or ends[-1] < len(data))


def test_cuts_are_those_of_the_rolling_hash():
    rng = random.Random(12)
    for n in (10, 2048, 2049, 60_000, 200_000):
        data = bytes(rng.getrandbits(8) for _ in range(n))
        assert media.cuts(data) == cuts_by_hand(data)
    assert media.cuts(b"\0" * 100_000) == cuts_by_hand(b"\0" * 100_000)


def test_equal_stretches_share_chunks():
    rng = random.Random(13)
    data = bytes(rng.getrandbits(8) for _ in range(200_000))
    a, b = ({d for d, _ in media.chunks(x)} for x in (data, b"some bytes before" + data))
    assert len(a & b) >= len(a) - 3


def test_query(spark):
    got = media.query(hard_docs(spark)).collect()
    want = []
    for r in hard_rows():
        data = (r[1] or "").encode()
        p = data + bytes(-len(data) % 64 or (0 if data else 64))
        m = media.to_wav(p)
        want.append((r[0], len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(p)))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)
    assert max(r["n_chunks"] for r in got) > 3
    assert media.query(no_docs(spark)).count() == 0


def test_lost_chunk_is_an_error(spark):
    lists, held = media.store(hard_docs(spark))
    with pytest.raises(Exception, match="lacks chunk"):
        media.restore(lists, held.limit(5)).collect()


def test_cuts_do_not_depend_on_the_blocks_that_are_hashed(monkeypatch):
    rng = np.random.default_rng(18)
    for n in (2047, 2049, 100_000, 500_001):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        whole = media.cuts(data)
        assert whole[-1] == n
        for size in (32, 1000, 4096):
            monkeypatch.setattr(media, "HASHED_TOGETHER", size)
            assert media.cuts(data) == whole
        monkeypatch.undo()
