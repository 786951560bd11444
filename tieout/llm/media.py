"""Media columns by content-defined chunking.

A payload becomes an 8-bit mono WAV. The file is cut where a rolling gear hash of its last 32 bytes has its upper bits
zero, so equal stretches give equal chunks wherever they stand. Chunks are kept once by digest; a file is the
ordered list of its chunks' digests. Reading back joins the lists with the chunks, puts them in order and checks the
file's SHA-256 before anything is computed from it; a missing or altered chunk is an error.

Null texts are empty; an empty payload is one block of zeros. Equal texts give equal files, which are put
together once. Repeated rows give repeated results; extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import bounded_batches, join_hot, text_or_empty, write_table

BLOCK = 64
RATE = 8000
HEADER = 44
LEAST_CHUNK, MOST_CHUNK = 2048, 32768
#: Upper bits of the gear hash that are zero at a cut: chunks have about 2 ** 13 bytes beyond the least.
CUT_BITS = 13
#: Bytes whose hashes are held at once, however long the file.
HASHED_TOGETHER = 1 << 20
DIGEST_BYTES = 16
BATCH = 256


@cache
def gear() -> np.ndarray:
    """A random-looking number for each byte, by rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples in a RIFF file."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", HEADER - 8 + len(payload), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a WAV file of one data chunk")
    return media[HEADER : HEADER + struct.unpack_from("<I", media, 40)[0]]


def _places(data: bytes, start: int) -> np.ndarray:
    """Places of a block after which the hash of the last 32 bytes is zero above; the block takes the bytes before it along."""
    carry = min(start, 31)
    h = gear()[np.frombuffer(data, np.uint8, min(len(data) - start, HASHED_TOGETHER) + carry, start - carry)]
    for reach in (1, 2, 4, 8, 16):  # h[i] is then of the last 2 * reach bytes
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
    return np.flatnonzero(h[carry:] >> np.uint32(32 - CUT_BITS) == 0) + start + 1


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [n]
    places = np.concatenate(list(map(partial(_places, data), range(0, n, HASHED_TOGETHER))))
    ends, start = [], 0
    while n - start > LEAST_CHUNK:
        k = np.searchsorted(places, start + LEAST_CHUNK)
        start = min(int(places[k]) if k < len(places) else n, start + MOST_CHUNK, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    ends = cuts(data)
    parts = [data[a:b] for a, b in zip([0, *ends], ends)]
    return [(hashlib.blake2b(p, digest_size=DIGEST_BYTES).digest(), p) for p in parts]


def feature(payload: bytes) -> str:
    """Of 8-bit samples: mean, root mean square about the middle, crossings of the middle a sample, entropy."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values, share = np.arange(256), counts[counts > 0] / len(x)
    mean, square = int((counts * values).sum()) / len(x), int((counts * (values - 128) ** 2).sum()) / len(x)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128))) / len(x)
    return f"mean={mean:.6f};rms={square**0.5:.6f};zcr={crossings:.6f};entropy={float(-(share * np.log2(share)).sum()):.6f}"


def _list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            texts = batch.column("text").to_pylist()
            media = [to_wav(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "media": pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                    "digests": pa.array([[d for d, _ in chunks(m)] for m in media], pa.list_(pa.binary())),
                }
            )


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=6).compress
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            found = dict(c for t in whole.slice(at, BATCH).column("text").to_pylist() for c in chunks(to_wav(payload_of(t))))
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(found), pa.binary()), "packed": pa.array(map(pack, found.values()), pa.binary())})


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The media column: rows (doc_id, n_bytes, media, digests), and the chunks (digest, packed) each once."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = bounded_batches(docs).select("doc_id", text_or_empty().alias("text"))
    lists = texts.mapInArrow(_list_batches, f"doc_id {id_type}, n_bytes long, media string, digests array<binary>")
    held = texts.select("text").mapInArrow(_chunk_batches, "digest binary, packed binary")
    return write_table(lists, "media_lists"), held.groupBy("digest").agg(F.first("packed").alias("packed"))


READ = pa.schema(
    [
        ("media", pa.string()),
        ("copies", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
    ]
)
READ_DDL = "media string, copies long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: str, copies: int, data: bytes) -> dict:
    own = hashlib.sha256(data).hexdigest()
    if own != media:
        raise ValueError(f"media {media} was put together as {own}")
    payload = from_wav(data)
    values = (media, copies, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), own, feature(payload))
    return dict(zip(READ.names, values))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (media, copies, n, at, digest, packed); those of a file come together and in order."""
    unpack = zstandard.ZstdDecompressor().decompress
    media, parts, out = None, [], []
    for batch in batches:
        for k in range(batch.num_rows):
            now, copies, n, at, packed = (batch.column(c)[k].as_py() for c in ("media", "copies", "n", "at", "packed"))
            if packed is None:
                raise ValueError(f"media {now} lacks chunk {at}")
            if now != media:
                media, parts = now, []
            if at != len(parts):
                raise ValueError(f"media {now} lacks chunk {len(parts)}")
            parts.append(unpack(packed))
            if len(parts) == n:
                out.append(read_back(now, copies, b"".join(parts)))
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, READ)
                    out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, READ)


def restore(lists: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of READ, one for each file: put together from its chunks, verified, and measured. Only files of several chunks
    need their chunks dealt out a second time."""
    files = lists.groupBy("media").agg(F.first("digests").alias("digests"), F.count(F.lit(1)).alias("copies"))
    wanted = files.select("media", "copies", F.size("digests").alias("n"), F.posexplode("digests").alias("at", "digest"))
    found = wanted.join(held, "digest", "left").select("media", "copies", "n", "at", "digest", "packed")
    alone = found.where("n = 1").mapInArrow(_read_batches, READ_DDL)
    several = found.where("n > 1").repartition("media").sortWithinPartitions("media", "at").mapInArrow(_read_batches, READ_DDL)
    return write_table(alone.unionByName(several), "media_read")


def query(docs: DataFrame) -> DataFrame:
    lists, held = store(docs)
    return join_hot(lists.select("doc_id", "n_bytes", "media", F.size("digests").alias("n_chunks")), restore(lists, held), ["media"], "copies").drop("media")
