"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 4 bits share at least 4 of their 8 bytes in place: the guaranteed minimum.
A posting list of a single positional byte would hold one in 256 of all documents, so a list is of three bytes at once. Of the
56 triples of positions 20 suffice: any four positions hold one of them, so fingerprints that share enough bytes meet in a list.
There the shared positional bytes of each pair are tallied; a pair that shares only the three of its list is dropped, one
that reaches the minimum is retained and verified by its differing bits.

Equal fingerprints are one node. A list is explored breadth first and gives edges of a spanning forest, not all its pairs.
No task holds a list of more than most_in_list. A longer one is dealt again by each of its other five bytes, of which four
differing bits leave one alone; what is longer even then is cut into blocks, and each two blocks meet in a task of their own.
Links become components by distributed star rounds.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give repeated results; documents
without doc_id get a component_id only from others; extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import bounded_batches, connected_components, join_hot, key_filter, passes, text_or_empty, write_table

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
BYTES = 8
MOST_IN_LIST = 50_000
#: Lists of so few members are compared all at once, one shift after the other.
SHORT_LIST = 8
BATCH = 512
#: Groups of positions. Triples within a group, or of two in one and one in the next, cover all sets of four.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def _covers(triple: tuple[int, ...]) -> bool:
    inside = [len(set(g) & set(triple)) for g in GROUPS]
    return any(inside[k] >= 2 and inside[k] + inside[(k + 1) % 3] == 3 for k in range(3))


POSITIONS = list(filter(_covers, combinations(range(BYTES), 3)))
MASKS = [sum(0xFF << 8 * p for p in c) for c in POSITIONS]


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], [*[c for c in batch.schema.names if c != "text"], "fp"])


def retained(differ: np.ndarray) -> np.ndarray:
    """Which pairs, given by the bits in which they differ, share the minimum of positional bytes."""
    return (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - MOST_BITS


def linked(differ: np.ndarray) -> np.ndarray:
    """Places of the pairs that the count filter retains and that are verified."""
    kept = np.flatnonzero(retained(differ))
    return kept[np.bitwise_count(differ[kept]) <= MOST_BITS]


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among fps; each fp is looked at once."""
    edges, left, queue = [], fps, []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        own = queue.pop()
        if not len(left):
            break
        near = linked(left ^ own)
        if len(near):
            edges += [(int(own), int(x)) for x in left[near]]
            queue += list(left[near])
            left = np.delete(left, near)
    return edges


def _rows(part: int, key: int, a, b) -> pa.RecordBatch:
    a, b = (np.asarray(x, np.uint64).view(np.int64) for x in (a, b))
    of = lambda x: pa.array(np.full(len(a), x, np.int64))
    return pa.RecordBatch.from_pydict({"part": of(part), "key": of(key), "a": pa.array(a), "b": pa.array(b)})


def _link_batches(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows come list by list (part, key). Edges have part -1; members of a list that is too long, its part and key."""
    part, key, held, spilt = None, None, [], False

    def over(parts: list[np.ndarray]) -> pa.RecordBatch | None:
        edges = forest(np.concatenate(parts)) if sum(map(len, parts)) > 1 else []
        return _rows(-1, 0, [a for a, _ in edges], [b for _, b in edges]) if edges else None

    for batch in batches:
        parts, keys, fps = (batch.column(c).to_numpy() for c in ("part", "key", "fp"))
        fps = fps.view(np.uint64)
        cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        short = np.zeros(len(starts), bool)  # lists that end within the batch, of few members
        short[1:-1] = True
        short &= ends - starts <= SHORT_LIST
        left = np.repeat(np.where(short, ends, 0), ends - starts) - np.arange(len(keys))
        for shift in range(1, SHORT_LIST):
            at = np.flatnonzero(left > shift)
            if not len(at):
                break
            near = at[linked(fps[at] ^ fps[at + shift])]
            if len(near):
                yield _rows(-1, 0, fps[near], fps[near + shift])
        for k in np.flatnonzero(~short).tolist():
            s, e = starts[k], ends[k]
            if (parts[s], keys[s]) != (part, key):
                if held and (rows := over(held)):
                    yield rows
                part, key, held, spilt = parts[s], keys[s], [], False
            held.append(fps[s:e])
            if most and sum(map(len, held)) > most or spilt:
                for x in held:
                    yield _rows(part, key, x, x)
                held, spilt = [], True
    if held and (rows := over(held)):
        yield rows


LINKS = "part long, key long, a long, b long"


def _dealt(postings: DataFrame, most: int | None, name: str) -> DataFrame:
    together = postings.select(F.col("part").cast("long").alias("part"), "key", "fp").repartition("part", "key").sortWithinPartitions("part", "key")
    return write_table(together.mapInArrow(partial(_link_batches, most=most), LINKS), name)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(nodes: DataFrame) -> DataFrame:
    """Rows (part, key, fp): the lists that each fingerprint is in."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in MASKS])
    return nodes.select("fp", F.posexplode(masks).alias("part", "mask")).select("part", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def link(nodes: DataFrame, most_in_list: int = MOST_IN_LIST) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (fp, distinct) which differ in few enough bits."""
    found = _dealt(postings(nodes), most_in_list, "simhash_links")
    edges = found.where("part < 0").select("a", "b")
    long_lists = found.where("part >= 0").select("part", "key", F.col("a").alias("fp"))
    if long_lists.isEmpty():
        return edges
    # by a fourth byte, one of those that the list's triple leaves
    fourth = F.array(*[F.array(*[F.struct(F.lit(p).alias("at"), F.lit(_signed(0xFF << 8 * p)).cast("long").alias("mask")) for p in range(BYTES) if p not in c]) for c in POSITIONS])
    again = long_lists.select("part", "key", "fp", F.explode(F.get(fourth, F.col("part").cast("int"))).alias("byte")).select(
        (F.col("part") * BYTES + F.col("byte.at")).alias("part"),
        F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("byte.mask"))).alias("key"),
        "fp",
    )
    found = _dealt(again, most_in_list, "simhash_links")
    edges = edges.unionByName(found.where("part < 0").select("a", "b"))
    long_lists = found.where("part >= 0").select("part", "key", F.col("a").alias("fp"))
    longest = long_lists.groupBy("part", "key").count().agg(F.max("count")).first()[0]
    if longest is None:
        return edges
    # each two blocks of a list, and each block alone
    blocks = -(-longest // most_in_list)
    own = F.pmod(F.xxhash64("fp"), F.lit(blocks))
    pairs = long_lists.select("part", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    pair = (F.col("part") * blocks + F.least("own", "other")) * blocks + F.greatest("own", "other")
    found = _dealt(pairs.select(pair.alias("part"), "key", "fp"), None, "simhash_links")
    return edges.unionByName(found.select("a", "b"))


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep, fp) of all documents."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    made = ", ".join([*[f"{c} {types[c]}" for c in keep], "fp long"])
    return write_table(bounded_batches(docs).select(*keep, text_or_empty().alias("text")).mapInArrow(_fingerprint_batches, made), "simhash")


def least_of_component(fps: DataFrame, value: Column, most_in_list: int = MOST_IN_LIST) -> DataFrame:
    """Rows (fp, least, copies): the least value of all rows whose fingerprints are linked, and the rows of each fingerprint.

    Rows are summed up by fingerprint first, so the table has one row for each fingerprint however many copies it has.
    """
    nodes = write_table(fps.groupBy("fp").agg(F.min(value).alias("own"), F.count(F.lit(1)).alias("copies")), "simhash_nodes")
    components = connected_components(link(nodes.select("fp"), most_in_list), "simhash_components").withColumnRenamed("node", "fp")
    placed = write_table(nodes.join(components, "fp", "left"), "simhash_placed")
    least = write_table(placed.where("component is not null").groupBy("component").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("members")), "simhash_least")
    linked_ones = join_hot(placed.where("component is not null"), least, ["component"], "members")
    alone = placed.where("component is null").select("fp", F.col("own").alias("least"), "copies")
    return write_table(alone.unionByName(linked_ones.select("fp", "least", "copies")), "simhash_found")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id; columns as they are. Rows alike in doc_id and text stay once.

    Rows sure to stay are left where they are; only those that may go, or stand repeatedly, are dealt out by a key of the row.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")
    keyed = whole.withColumn("row", F.md5(F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"})))
    fps = fingerprints(keyed.select("doc_id", "text", "row"), ["doc_id", "row"])
    found = least_of_component(fps, F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    kept = found.select(F.col("least.row").alias("row"), F.lit(True).alias("stays")).distinct()
    rows = fps.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    own_id = F.xxhash64("row").alias("id")
    judged = write_table(rows.join(kept, "row", "left").where("stays is null or times > 1"), "simhash_judged")
    marked = passes(keyed.select("doc", "row", own_id), key_filter(judged.select(own_id), "id"), "id", "hit")
    met = marked.where("hit").select("doc", "row").join(judged.hint("merge"), "row", "left")
    nth = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    stay = met.withColumn("nth", nth).where("times is null or (stays and nth = 1)")
    return marked.where("not hit").select("doc.*").unionByName(stay.select("doc.*"))


def query(docs: DataFrame) -> DataFrame:
    fps = fingerprints(docs, ["doc_id"])
    found = least_of_component(fps, F.col("doc_id")).select("fp", F.col("least").alias("component_id"), "copies")
    return join_hot(fps, found, ["fp"], "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
