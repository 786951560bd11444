"""BPE encoding and decoding by tree concatenation.

A text longer than a leaf is cut into halves again and again; the leaves are encoded independently, and each join
re-encodes a window around the cut that grows until both sides agree with it exactly. Two kinds of agreement are
exact, and only these are accepted:

* a boundary of the splitting pattern: white space after anything else, or a letter, a digit or another mark after one of
  another class, but for what follows an apostrophe. No piece reaches over it and none looks back, so what stands
  before and after is encoded alone. Classes are taken as known where Unicode 3.2 and the present one agree;
* inside one unsplit run of letters, digits or other marks, of any script, the window's first token is the left side's
  token at that place and its last token the right side's. A token sequence is the encoding of a run if and only if each
  neighbouring pair is the encoding of its own bytes, and all pairs then come from one of three valid encodings.

Texts beyond spread_chars are dealt out: each distinct one is cut in one pass, its leaves become rows, are encoded by
different tasks and joined after one shuffle by text. The ids are the same either way. Null texts count as empty; an empty text has no tokens. Equal rows give equal rows; only
doc_id and text are read, so further columns of any name do no harm; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import bounded_batches, text_or_empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of which all regular-expression engines know the class: there both libraries split alike.
SAFE = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]*")
#: Runs of one of these classes are never cut by the splitting pattern.
CLASSES = {"L": "letter", "N": "digit", "M": "mark", "P": "mark", "S": "mark"}
LEAF_CHARS = 4096
SPREAD_CHARS = 65536
#: Documents or leaves in one Arrow batch of results.
BATCH = 256
LEAVES = pa.schema([("key", pa.string()), ("n", pa.int64()), ("run", pa.int64()), ("leaf", pa.string())])
LEAVES_DDL = "key string, n long, run long, leaf string"


def byte_alphabet() -> dict[str, int]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """A byte-level BPE vocabulary file of the tokenizers library, for whole texts of any length."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        self.path, self.leaf_chars = path, leaf_chars
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pieces = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for piece, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.pieces[i] = piece
        self.lengths = np.array([len(x) for x in self.pieces], np.int64)
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._whole = None

    @property
    def whole(self):
        """The library itself, for texts with characters that are not safe; loaded when one comes."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def encode(self, text: str) -> np.ndarray:
        """ids of a whole text as unsigned 32-bit integers."""
        parts = [
            [self.special[part]] if k % 2 else self._tree(part)
            for k, part in enumerate(self.split_special.split(text))
            if part
        ]
        return np.concatenate([np.asarray(p, np.uint32) for p in parts]) if parts else np.empty(0, np.uint32)

    def leaf(self, text: str) -> np.ndarray:
        """ids of a text without special tokens, encoded in one go."""
        if SAFE.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _tree(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        cuts = leaf_cuts(len(text), self.leaf_chars)
        return self.concatenate([(text[a:b].encode(), self.leaf(text[a:b])) for a, b in zip(cuts, cuts[1:])])

    def concatenate(self, parts: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """ids of consecutive parts of one text, joined pair by pair up the tree."""
        while len(parts) > 1:
            pairs = [(a[0] + b[0], self.join(*a, *b)) for a, b in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0][1] if parts else np.empty(0, np.uint32)

    def join(self, left: bytes, left_ids: np.ndarray, right: bytes, right_ids: np.ndarray) -> np.ndarray:
        reach = 16
        while True:
            a, b = max(0, len(left_ids) - reach), min(len(right_ids), reach)
            starts = len(left) - np.cumsum(self.lengths[left_ids[a:]][::-1])[::-1]
            ends = np.cumsum(self.lengths[right_ids[:b]])
            lo = next((a + i for i, p in enumerate(starts.tolist()) if opens(left, p)), 0 if a == 0 else None)
            hi = next((j for j in range(b, 0, -1) if opens(right, int(ends[j - 1]))), len(right_ids) if b == len(right_ids) else None)
            if lo is not None and hi is not None:
                start = int(starts[lo - a]) if lo < len(left_ids) else len(left)
                end = int(ends[hi - 1]) if hi else 0
                seam = self.leaf((left[start:] + right[:end]).decode())
                return np.concatenate([left_ids[:lo], seam, right_ids[hi:]])
            if reach >= 64 and a > 0 and b < len(right_ids):
                before, after = int(starts[0]) - int(self.lengths[left_ids[a - 1]]), int(ends[-1]) + int(self.lengths[right_ids[b]])
                if one_class(left, before, right, after):
                    seam = np.array(self.fast._encode_single_piece(left[int(starts[0]) :] + right[: int(ends[-1])]), np.uint32)
                    if seam[0] == left_ids[a] and seam[-1] == right_ids[b - 1]:
                        return np.concatenate([left_ids[:a], seam, right_ids[b:]])
            reach *= 2

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def class_of(char: str) -> str | None:
    """letter, digit, mark, apostrophe or space; None where it is not sure that all engines agree."""
    if char in " \t\n\r":
        return "space"
    if char == "'":
        return "apostrophe"
    then, now = unicodedata.ucd_3_2_0.category(char), unicodedata.category(char)
    return CLASSES.get(now[0]) if then[0] == now[0] else None


def char_start(data: bytes, p: int) -> int:
    """Where the character begins that the byte at p is part of."""
    while p > 0 and data[p] & 0xC0 == 0x80:
        p -= 1
    return p


def char_end(data: bytes, p: int) -> int:
    """The next place from p on where a character begins, or the end."""
    while p < len(data) and data[p] & 0xC0 == 0x80:
        p += 1
    return p


def opens(data: bytes, p: int) -> bool:
    """Whether a piece starts at p in whatever text data is part of."""
    if not 0 < p < len(data) or data[p] & 0xC0 == 0x80:
        return False
    before = class_of(data[char_start(data, p - 1) : p].decode())
    here = class_of(data[p : char_end(data, p + 1)].decode())
    if before is None or here is None or before == "space":
        return False
    if here == "space":
        return True
    return before != "apostrophe" and before != here and {before, here} != {"mark", "apostrophe"}


def one_class(left: bytes, start: int, right: bytes, end: int) -> bool:
    """Whether all characters that left from start and right up to end touch are of one unsplit run."""
    touched = left[char_start(left, start) :] + right[: char_end(right, end)]
    classes = set(map(class_of, touched.decode()))
    return len(classes) == 1 and classes <= set(CLASSES.values())


def leaf_cuts(length: int, leaf_chars: int) -> list[int]:
    """Ends of the leaves when length is halved until no part is longer than a leaf."""
    parts = 1
    while -(-length // parts) > leaf_chars:
        parts *= 2
    return [length * k // parts for k in range(parts + 1)]


@cache
def codec(path: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    """One codec for each Python worker and vocabulary."""
    return Codec(path, leaf_chars)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, leaf_chars: int, decode: bool) -> Iterator[pa.RecordBatch]:
    own = codec(path, leaf_chars)
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield result_batch(batch.column("doc_id"), ids, own, decode)


def result_batch(doc_id: pa.Array, ids: list[np.ndarray], own: Codec, decode: bool) -> pa.RecordBatch:
    columns = {"doc_id": doc_id, "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())}
    if decode:
        columns["decoded"] = pa.array([own.decode(x) for x in ids], pa.string())
    return pa.RecordBatch.from_pydict(columns)


def _cut_batches(batches: Iterator[pa.RecordBatch], path: str, leaf_chars: int) -> Iterator[pa.RecordBatch]:
    """The leaves (key, n, run, leaf) of whole texts, each text cut in one pass. Special tokens are cut out first and are runs
    of an odd number, so no cut splits one."""
    own, rows = codec(path), []

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict(dict(zip(("key", "n", "run", "leaf"), map(list, zip(*rows)))), LEAVES)
        rows.clear()
        return batch

    for batch in batches:
        for k, key in enumerate(batch.column("key").to_pylist()):
            n = 0
            for run, part in enumerate(own.split_special.split(batch.column("text")[k].as_py())):
                cuts = leaf_cuts(len(part), leaf_chars) if part else [0]
                for a, b in zip(cuts, cuts[1:]):
                    rows.append((key, n, run, part[a:b]))
                    n += 1
                    if len(rows) >= BATCH:
                        yield made()
    if rows:
        yield made()


def _leaf_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Leaves with the ids of each, alone."""
    own = codec(path)
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            leaves = zip(batch.column("run").to_pylist(), batch.column("leaf").to_pylist())
            ids = [np.array([own.special[x]], "<u4") if run % 2 else own.leaf(x).astype("<u4") for run, x in leaves]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in ids], pa.binary())], [*batch.schema.names, "ids"])


def _join_batches(batches: Iterator[pa.RecordBatch], path: str, leaf_chars: int, decode: bool) -> Iterator[pa.RecordBatch]:
    """The leaves of a text come together and in order; those of a run are joined up its tree."""
    own = codec(path, leaf_chars)

    def ended(key: str, runs: list[list]) -> pa.RecordBatch:
        ids = np.concatenate([own.concatenate(parts) for parts in runs])
        return result_batch(pa.array([key], pa.string()), [ids], own, decode).rename_columns(["key", "ids", *["decoded"] * decode])

    key, run, runs = None, None, []
    for batch in batches:
        for now, own_run, leaf, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "leaf", "ids"))):
            if now != key:
                if runs:
                    yield ended(key, runs)
                key, run, runs = now, None, []
            if own_run != run:
                run, runs = own_run, [*runs, []]
            runs[-1].append((leaf.encode(), np.frombuffer(ids, "<u4")))
    if runs:
        yield ended(key, runs)


def encode(
    docs: DataFrame,
    path: str = VOCABULARY,
    leaf_chars: int = LEAF_CHARS,
    spread_chars: int = SPREAD_CHARS,
    decode: bool = False,
) -> DataFrame:
    """Rows (doc_id, ids, and decoded if asked for) of documents (doc_id, text); ids are little-endian unsigned
    32-bit integers in one binary."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded_batches(docs).select("doc_id", text_or_empty().alias("text"))
    made = "ids binary" + ", decoded string" * decode
    short = rows.where(F.char_length("text") <= spread_chars).mapInArrow(
        partial(_encode_batches, path=path, leaf_chars=leaf_chars, decode=decode), f"doc_id {id_type}, {made}"
    )
    long = rows.where(F.char_length("text") > spread_chars).withColumn("key", F.sha2("text", 256))
    leaves = long.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(partial(_cut_batches, path=path, leaf_chars=leaf_chars), LEAVES_DDL)
    joined = (
        leaves.repartition("key", "n")
        .mapInArrow(partial(_leaf_batches, path=path), LEAVES_DDL + ", ids binary")
        .repartition("key")
        .sortWithinPartitions("key", "n")
        .mapInArrow(partial(_join_batches, path=path, leaf_chars=leaf_chars, decode=decode), f"key string, {made}")
    )
    return short.unionByName(long.select("doc_id", "key").join(joined, "key").drop("key"))


def query(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded text."""
    return encode(docs, decode=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
