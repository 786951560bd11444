"""Substring dedup by fixed-block anchors.

A window of 35 words holds at least one whole block of 18 words that starts at a multiple of 18, so the non-overlapping
blocks are the index, and every window of 18 words probes it. Of two places of a repeat, one sees the
other's blocks at a shift of at most 9 words (modulo 18): probes at the first ten residues find every pair from one side
or the other. A hit is extended: the 35-word windows around it, in both documents, are compared among all windows so
found, and runs of windows that start elsewhere too are the maximal exact repeats. All of their words are removed.

Probes and windows travel packed: a task gathers, for each bucket of hash values, the prints, the places and the texts'
keys of many documents in one row. What a task already sees repeated it resolves itself and sends on as one
entry, so a passage of a third of all documents does not meet in one task. Texts that are equal as a whole are one text
with a number of copies. The words are removed as judged on the input.

Null and empty texts have no words. Repeated rows are copies of each other; extra columns are not read; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import bounded_batches, join_hot, key_filter, passes, text_or_empty, write_table

WINDOW = 35
#: Entries of a bucket, which one Python worker holds.
IN_BUCKET = 1 << 22
#: Words of which one task gathers the entries before it packs them.
GATHERED = 1 << 22
#: Words whose hashes a Python worker remembers.
REMEMBERED = 1 << 19
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
PROVEN = np.uint32(1 << 31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        own = self[word] = xxhash.xxh3_64_intdigest(word)
        return own


_hashes = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), U64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, by prefix sums of a polynomial modulo 2 ** 64."""
    if len(h) < n:
        return np.empty(0, U64)
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    down, up = (np.multiply.accumulate(np.full(len(h), x, U64)) for x in (inverse, BASE))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * down, dtype=U64)])
    return mixed((sums[n:] - sums[:-n]) * up[: len(h) - n + 1])


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte by byte of significance: zeros stand together."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


PACKED = pa.schema([("bucket", pa.int32()), ("hit", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("prints", pa.binary())])
PACKED_DDL = "bucket int, hit boolean, keys binary, counts binary, places binary, prints binary"
HITS_DDL = "key long, places binary"


def repeated(prints: np.ndarray, keys: np.ndarray, places: np.ndarray, block: int, proven: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The entries whose print stands at two places or more, at least one the start of a block; and for each such print
    one entry that starts a block."""
    if not len(prints):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((places % block != 0, prints))
    p, k, at = prints[order], keys[order], places[order]
    starts = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p))))
    first = starts[group]
    several = np.logical_or.reduceat((k != k[first]) | (at != at[first]), starts)
    if proven is not None:
        several |= np.logical_or.reduceat(proven[order], starts)
    several &= at[starts] % block == 0
    return order[several[group]], order[starts[several]]


class Packer:
    """Gathers entries (hash, key, place) and packs them into rows by bucket."""

    def __init__(self, bits: int, block: int, wide: bool):
        self.bits, self.block, self.wide = bits, block, wide
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words = 0

    def add(self, high: np.ndarray, low: np.ndarray, key: int, places: np.ndarray, words: int) -> None:
        """high deals to buckets; low is the print: 64 bits of another hash if wide, else the next 32 of high."""
        self.parts.append((high, low, np.full(len(high), key, np.int64), places.astype(np.uint32)))
        self.words += words

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        high, low, keys, places = map(np.concatenate, zip(*self.parts))
        self.parts, self.words = [], 0
        hits, one = repeated(low ^ high if self.wide else high, keys, places, self.block)
        places[one] |= PROVEN
        sent = np.ones(len(high), bool)
        sent[hits] = False
        sent[one] = True
        if len(hits):
            yield pack_hits(keys[hits], places[hits] & ~PROVEN, self.bits)
        high, low, keys, places = high[sent], low[sent], keys[sent], places[sent]
        bucket = top_bits(high, self.bits)
        prints = low if self.wide else ((high << U64(self.bits)) >> U64(32)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        if len(order):
            yield pack(bucket[order], False, keys[order], places[order], prints[order])



def pack(bucket: np.ndarray, hit: bool, keys: np.ndarray, places: np.ndarray, prints: np.ndarray | None) -> pa.RecordBatch:
    """One row for each bucket; bucket is sorted, and keys within it."""
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist()
    out: dict[str, list] = {c: [] for c in PACKED.names}
    for a, b in zip(cuts, cuts[1:]):
        k = keys[a:b]
        runs = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [b - a]])
        own = (k[runs[:-1]].astype("<i8").tobytes(), planes(np.diff(runs)), planes(places[a:b]), b"" if prints is None else prints[a:b].tobytes())
        for c, x in zip(out.values(), (int(bucket[a]), hit, *own)):
            c.append(x)
    return pa.RecordBatch.from_pydict(out, PACKED)


def top_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def pack_hits(keys: np.ndarray, places: np.ndarray, bits: int) -> pa.RecordBatch:
    """Hits by buckets of their keys."""
    bucket = top_bits(mixed(keys.view(U64)), bits)
    order = np.lexsort((places, keys, bucket))
    return pack(bucket[order], True, keys[order], places[order], None)


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(row[0], "<i8"), from_planes(row[1])), from_planes(row[2])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(entries, hits) of each bucket, whose rows come together."""
    bucket, held = None, ([], [])
    for batch in batches:
        for now, hit, *row in zip(*(batch.column(c).to_pylist() for c in PACKED.names)):
            if now != bucket:
                yield held
                bucket, held = now, ([], [])
            held[hit].append(row)
    yield held


def _resolve_batches(batches: Iterator[pa.RecordBatch], block: int, wide: bool, bits: int) -> Iterator[pa.RecordBatch]:
    """The hits of a bucket's entries, by buckets of their keys; hits found before go on."""
    for entries, hits in _by_bucket(batches):
        for row in hits:
            yield pack_hits(*_unpacked(row), bits)
        if entries:
            keys, places = map(np.concatenate, zip(*map(_unpacked, entries)))
            prints = np.concatenate([np.frombuffer(row[3], "<u8" if wide else "<u4") for row in entries])
            proven = places & PROVEN != 0
            places = places & ~PROVEN
            found, _ = repeated(prints, keys, places, block, proven)
            if len(found):
                yield pack_hits(keys[found], places[found], bits)


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (key, places) for each text with hits."""
    for _, hits in _by_bucket(batches):
        if not hits:
            continue
        keys, places = map(np.concatenate, zip(*map(_unpacked, hits)))
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order].astype("<u4")
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for at in range(0, len(cuts) - 1, 5000):
            own = cuts[at : at + 5001].tolist()
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[own[:-1]]), "places": pa.array([places[a:b].tobytes() for a, b in zip(own, own[1:])], pa.binary())})


def _probe_batches(batches: Iterator[pa.RecordBatch], bits: int, window: int) -> Iterator[pa.RecordBatch]:
    block = (window + 1) // 2
    packer, seen = Packer(bits, block, False), set()
    for batch in batches:
        texts = batch.column("text")
        for k, key in enumerate(batch.column("key").to_pylist()):
            if key in seen:  # a copy has no places of its own
                continue
            words = texts[k].as_py().encode().split()
            if len(words) < window:
                continue
            seen.add(key)
            high = rolling(word_hashes(words), block)
            places = np.arange(len(high))
            probed = places % block <= block // 2
            packer.add(high[probed], high[probed], key, places[probed], len(words))
            if packer.words >= GATHERED:
                yield from packer.flush()
                seen.clear()
    yield from packer.flush()


def _window_batches(batches: Iterator[pa.RecordBatch], bits: int, window: int) -> Iterator[pa.RecordBatch]:
    block = (window + 1) // 2
    packer = Packer(bits, 1, True)
    for batch in batches:
        texts, hits = batch.column("text"), batch.column("hits")
        for k, key in enumerate(batch.column("key").to_pylist()):
            words = texts[k].as_py().encode().split()
            h = word_hashes(words)
            high, low = rolling(h, window), rolling(mixed(h ^ BASE), window)
            found = np.frombuffer(hits[k].as_py(), "<u4").astype(np.int64)
            step = np.zeros(len(high) + block + 1, np.int64)  # a window around a hit starts up to window - block before
            np.add.at(step, np.maximum(found - (window - block), 0), 1)
            np.add.at(step, np.minimum(found + 1, len(step) - 1), -1)
            places = np.flatnonzero(np.cumsum(step)[: len(high)] > 0)
            packer.add(high[places], low[places], key, places, len(words))
            if packer.words >= GATHERED:
                yield from packer.flush()
    yield from packer.flush()


def _keep_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            removed, kept = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = text.encode().split()
                found = np.frombuffer(starts, "<u4").astype(np.int64)
                step = np.zeros(len(words) + window + 1, np.int64)
                np.add.at(step, found, 1)
                np.add.at(step, found + window, -1)
                stays = np.cumsum(step)[: len(words)] == 0
                removed.append(int(len(words) - stays.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays).tolist()]).decode())
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "print": batch.column("print"), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})


SPACES = r"[\x20\x09-\x0D]+"


def one_spaced(text: Column) -> Column:
    """The words of a text, joined by one space."""
    return F.btrim(F.regexp_replace(text, SPACES, " "), F.lit(" "))


def identity() -> list[Column]:
    """A text's key, of 64 bits, and its print, which tells texts of one key apart."""
    return [F.xxhash64(text_or_empty()).alias("key"), F.unhex(F.md5(text_or_empty())).alias("print")]


def buckets_for(entries: int, in_bucket: int) -> int:
    """Bits of the bucket number."""
    return max(0, -(-entries // in_bucket) - 1).bit_length()


def resolve(packed: DataFrame, block: int, wide: bool, bits: int, name: str) -> DataFrame:
    """Rows (key, name): the places of each text's entries that are hits. Buckets are dealt to tasks of about one each, so
    that more entries make more tasks and not larger ones."""
    together = lambda df: df.repartition(2 << bits, "bucket").sortWithinPartitions("bucket")
    hits = together(packed).mapInArrow(partial(_resolve_batches, block=block, wide=wide, bits=bits), PACKED_DDL)
    return together(hits).mapInArrow(_merge_batches, HITS_DDL).withColumnRenamed("places", name)


def repeats(docs: DataFrame, n_words: int, window: int = WINDOW, in_bucket: int = IN_BUCKET) -> DataFrame:
    """Rows (key, print, n_removed, kept) of the distinct texts that have repeats, copies apart."""
    block = (window + 1) // 2
    texts = bounded_batches(docs).select(*identity(), text_or_empty().alias("text"))
    bits = buckets_for(n_words * (block // 2 + 1) // block, in_bucket)
    probes = texts.select("key", "text").mapInArrow(partial(_probe_batches, bits=bits, window=window), PACKED_DDL)
    hits = write_table(resolve(probes, block, False, bits, "hits"), "substring_hits")
    # texts sure to have no hit stay where they are
    hit = passes(texts, key_filter(hits, "key"), "key", "hit").where("hit").drop("hit")
    # by key alone, as the hits are, so that texts are dealt out once; prints tell the few texts of one key apart
    by_key = hit.groupBy("key").agg(F.collect_set(F.struct("print", "text")).alias("own"))
    hit_texts = write_table(by_key.join(hits, "key").select("key", "hits", F.inline("own")), "substring_texts")
    bits = buckets_for(hit_texts.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6, in_bucket)
    windows = hit_texts.select("key", "text", "hits").mapInArrow(partial(_window_batches, bits=bits, window=window), PACKED_DDL)
    found = resolve(windows, 1, True, bits, "starts")
    return hit_texts.select("key", "print", "text").join(found, "key").mapInArrow(
        partial(_keep_batches, window=window), "key long, print binary, n_removed long, kept string"
    )


def judge(docs: DataFrame, keep: list[str], window: int = WINDOW, in_bucket: int = IN_BUCKET) -> DataFrame:
    """Rows (keep, key, print, n_words, whole_sha256, copies) of all documents."""
    joined = one_spaced(text_or_empty())
    rows = docs.select(*keep, *identity(), joined.alias("joined")).select(
        *keep,
        "key",
        "print",
        F.when(F.col("joined") == "", 0).otherwise(F.char_length("joined") - F.char_length(F.replace("joined", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.sha2("joined", 256).alias("whole_sha256"),
    )
    return write_table(rows, "substring_rows")


def query(docs: DataFrame, window: int = WINDOW, in_bucket: int = IN_BUCKET) -> DataFrame:
    rows = judge(docs, ["doc_id"], window)
    n_words = rows.select(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    found = repeats(docs, n_words, window, in_bucket).select("key", "print", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    copies = rows.groupBy("key", "print").agg(F.count(F.lit(1)).alias("copies"))
    text = write_table(copies.join(found, ["key", "print"], "left").withColumn("copies_", F.col("copies")), "substring_found")
    gone = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return join_hot(rows, text, ["key", "print"], "copies_").select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, in_bucket: int = IN_BUCKET) -> DataFrame:
    """The documents without their repeats: text and n_chars change where words are removed, no row goes.

    Documents whose text is sure not to change stay where they are; the others meet their new texts by key.
    """
    rows = judge(docs, [], window)
    n_words = rows.select(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    found = repeats(docs, n_words, window, in_bucket).select("key", "print", F.when(F.col("n_removed") > 0, F.col("kept")).alias("kept"))
    copies = rows.groupBy("key", "print").agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"))
    new_text = F.when((F.col("copies") > 1) & (F.col("n_words") >= window), F.lit("")).otherwise(F.col("kept"))
    text = copies.join(found, ["key", "print"], "left").select("key", "print", "copies", new_text.alias("kept"))
    changed = write_table(text.where("kept is not null"), "substring_changed")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *identity())
    marked = passes(whole, key_filter(changed, "key"), "key", "hit")
    joined = join_hot(marked.where("hit").select("row", "key", "print"), changed, ["key", "print"], "copies", "left").select("row", "kept")
    both = marked.where("not hit").select("row", F.lit(None).cast("string").alias("kept")).unionByName(joined)
    new = {"text": F.coalesce("kept", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept").isNotNull(), F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return both.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
