"""Line deduplication with a sharded minimal perfect hash.

1. Every document emits a 128-bit hash of each distinct long key once; a groupBy with
   map-side combine gives the number of documents and the largest doc_id per hash.
   A line that a third of all documents hold is one row per map task there.
2. Hashes of two documents or more are dealt to shards by their bits; a hash that is in no
   shard is in one document, where no threshold can drop it. Each shard becomes one row:
   a minimal perfect hash (hash and displace) over its hashes, and by its slots an array
   of 64-bit fingerprints, an array of counts and an array of the largest doc_id.
3. Documents probe these arrays; the count found decides. An index within
   ``broadcast_bytes`` travels to the executors once and the rewrite is a map over the
   scan; beyond it each document sends its hashes to the shards that own them, hot shards
   being served in salted copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise, prepare

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = np.iinfo(np.int64).min
ARRAYS = ("seeds", "prints", "counts", "docs")
KEY_BYTES = 8 + 4 + 8 + 1  # of a hash in the arrays
INDEX_SCHEMA = "shard int, seeds binary, prints binary, counts binary, docs binary"


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line in UTF-8, or None if it has fewer than ``least`` code points."""
    key = line.strip(SPACE).lower()  # bytes.lower changes A-Z only
    if len(key) < least or len(key) < 4 * least and not key.isascii() and len(key.decode()) < least:
        return None
    return key


def key_hashes(text: str | None, least: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines of a text, the numbers of those with a key, and the keys' hashes (n x 2, uint64)."""
    lines = (text or "").encode().split(b"\n")
    at, raw = [], []
    for i, line in enumerate(lines):
        if len(line) >= least and (key := line_key(line, least)) is not None:
            at.append(i)
            raw.append(xxhash.xxh3_128_digest(key))
    return lines, np.array(at, np.int64), np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)


# --- minimal perfect hash ---------------------------------------------------------


def mix(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit finaliser over x and a seed."""
    z = x + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def blend(hashes: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of 128-bit hashes (n x 2)."""
    return mix(hashes[:, 0], salt) ^ hashes[:, 1]


def distinct_salt(hashes: np.ndarray) -> int:
    """The least salt whose blends of distinct hashes are distinct."""
    salt = 0
    while len(np.unique(blend(hashes, salt))) < len(hashes):
        salt += 1
    return salt


DIRECT = np.uint32(1 << 31)  # a seed from here on is a slot


def build_mph(keys: np.ndarray, load: int = 4) -> np.ndarray:
    """Seeds, one per bucket, that send the distinct uint64 keys one-to-one to
    0..n-1. Buckets are placed largest first, all of one size together: in each round
    those that are left try the same seed, and of buckets that want one free slot the first
    gets it. A bucket of one key is given a free slot outright."""
    n = len(keys)
    buckets = max(1, -(-n // load))
    seeds, free = np.zeros(buckets, np.uint32), np.ones(n, bool)
    bucket = (mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begins = np.searchsorted(bucket[order], np.arange(buckets))
    sizes = np.bincount(bucket, minlength=buckets)
    for size in range(int(sizes.max(initial=0)), 1, -1):
        left = np.flatnonzero(sizes == size)
        own = keys[order[begins[left][:, None] + np.arange(size)]]
        seed = 0
        while len(left):
            seed += 1
            slots = (mix(own, seed) % np.uint64(n)).astype(np.int64)
            apart = np.sort(slots, axis=1)
            fit = np.flatnonzero(free[slots].all(axis=1) & (apart[:, 1:] != apart[:, :-1]).all(axis=1))
            if len(fit):
                wanted = slots[fit].ravel()
                _, first = np.unique(wanted, return_index=True)
                granted = np.zeros(len(wanted), bool)
                granted[first] = True
                won = fit[granted.reshape(-1, size).all(axis=1)]
                seeds[left[won]] = seed
                free[slots[won]] = False
                stay = np.ones(len(left), bool)
                stay[won] = False
                left, own = left[stay], own[stay]
    single = np.flatnonzero(sizes == 1)
    seeds[single] = np.flatnonzero(free).astype(np.uint32) | DIRECT
    return seeds


def slot_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    seed = seeds[(mix(keys, 0) % np.uint64(len(seeds))).astype(np.int64)]
    slots = (mix(keys, seed.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    return np.where(seed >= DIRECT, np.minimum(seed & ~DIRECT, n - 1), slots)


class Shard:
    """The arrays of one shard, ready to be probed. The first seed is the salt of its hashes."""

    def __init__(self, seeds: bytes, prints: bytes, counts: bytes, docs: bytes):
        self.seeds, self.prints, self.counts, self.docs = (np.frombuffer(x, t) for x, t in zip((seeds, prints, counts, docs), (np.uint32, np.uint64, np.uint32, np.int64), strict=True))

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes (n x 2) in how many documents they are (0: not in the shard) and the
        largest doc_id."""
        slots = slot_of(blend(hashes, int(self.seeds[0])), self.seeds[1:], len(self.prints))
        return np.where(self.prints[slots] == hashes[:, 1], self.counts[slots], 0), self.docs[slots]


def build_shard(hashes: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """The arrays of a shard of distinct hashes (n x 2)."""
    salt = distinct_salt(hashes)
    keys = blend(hashes, salt)
    seeds = build_mph(keys)
    slots = slot_of(keys, seeds, len(keys))
    prints, counts, docs = np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
    prints[slots], counts[slots], docs[slots] = hashes[:, 1], np.minimum(count, np.iinfo(np.uint32).max), doc
    return np.concatenate(([np.uint32(salt)], seeds)).astype(np.uint32).tobytes(), prints.tobytes(), counts.tobytes(), docs.tobytes()


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task holds the shards dealt to it: about one, of ``keys_per_shard`` keys."""
    held = [x for x in batches if x.num_rows]
    if not held:
        return
    frame = pa.Table.from_batches(held)
    shard, count, doc = (frame[c].to_numpy() for c in ("shard", "n", "doc"))
    hashes = np.column_stack([frame[c].to_numpy() for c in ("a", "b")]).view(np.uint64)
    for s in np.unique(shard):
        own = shard == s
        arrays = build_shard(hashes[own], count[own], doc[own])
        yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), *(pa.array([x], pa.binary()) for x in arrays)], names=["shard", *ARRAYS])


# --- counting ---------------------------------------------------------------------


def _emit_hashes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = [], []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            _, _, h = key_hashes(text.as_py(), least)
            if len(h):
                h = np.unique(h, axis=0) if len(h) > 1 else h
                hashes.append(h)
                ids.append(np.full(len(h), NO_ID if (x := doc_id.as_py()) is None else x, np.int64))
        if hashes:
            h = np.concatenate(hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(np.concatenate(ids))], names=["a", "b", "doc"])


def build_index(docs: DataFrame, least_chars: int, keys_per_shard: int) -> tuple[DataFrame, int, int, int]:
    """The shard rows (in the shared folder), their number, their bytes, and the most
    probes that any shard will find in its arrays."""
    spark = docs.sparkSession
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_emit_hashes, least=least_chars), "a long, b long, doc long").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc").alias("doc"))
    repeated = materialise(counted.where("n > 1"), "line-keys")
    total = repeated.count()
    if not total:
        return spark.createDataFrame([], INDEX_SCHEMA), 1, 0, 0
    shards = max(1, -(-total // keys_per_shard))
    dealt = repeated.withColumn("shard", F.pmod(F.hash("b"), F.lit(shards)).cast("int"))
    hottest = dealt.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    index = dealt.select("shard", "a", "b", "n", "doc").repartition(shards, "shard").mapInArrow(_build_shards, INDEX_SCHEMA)
    return materialise(index, "line-index"), shards, total * KEY_BYTES, hottest


def shard_numbers(hashes: np.ndarray, shards: int) -> np.ndarray:
    """``pmod(hash(b), shards)`` as Spark computes it (Murmur3 of a long, seed 42)."""
    x = hashes[:, 1].astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(x), 42, np.uint32)
        for word in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
            k = word * np.uint32(0xCC9E2D51)
            k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
            h ^= k
            h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % shards


# --- rewriting --------------------------------------------------------------------


def rewritten(lines: list[bytes], drop: list[int]) -> bytes:
    gone = set(drop)
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else b"\n".join(lines)


def _outcome(batch: pa.RecordBatch, drops: list[list[int]], texts: bool) -> pa.RecordBatch:
    """The batch's columns with what is left of each text; drops: numbers of lines by row."""
    n, gone, sha, kept = [], [], [], []
    for text, drop in zip(batch.column("text"), drops, strict=True):
        lines = (text.as_py() or "").encode().split(b"\n")
        left = rewritten(lines, drop)
        n.append(len(lines))
        gone.append(len(drop))
        if texts:
            kept.append(left.decode())
        else:
            sha.append(hashlib.sha256(left).hexdigest())
    if texts:
        return pa.RecordBatch.from_arrays([*(batch.column(c) if c != "text" else pa.array(kept, pa.string()) for c in batch.schema.names)], names=batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _probe_broadcast(batches: Iterator[pa.RecordBatch], index, shards: int, least: int, least_docs: int, texts: bool) -> Iterator[pa.RecordBatch]:
    held = {s: Shard(*x) for s, *x in index.value}
    for batch in batches:
        lines, hashes, ids = [], [], []
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            _, at, h = key_hashes(text.as_py(), least)
            lines.append(at)
            hashes.append(h)
            ids.append(NO_ID if (x := doc_id.as_py()) is None else x)
        if not lines:
            continue
        ends = np.cumsum([0, *map(len, lines)])
        h, own = np.concatenate(hashes), np.repeat(np.array(ids, np.int64), np.diff(ends))
        drop, numbers = np.zeros(len(h), bool), shard_numbers(h, shards)
        for s, shard in held.items():  # each shard once a batch
            mine = np.flatnonzero(numbers == s)
            count, keeper = shard.probe(h[mine])
            drop[mine] = (count >= least_docs) & (keeper != own[mine])
        yield _outcome(batch, [at[drop[a:b]].tolist() for at, a, b in zip(lines, ends, ends[1:], strict=False)], texts)


MIXED = "shard int, salt int, kind int, doc_id long, text_hash long, line int, a long, b long, seeds binary, prints binary, counts binary, docs binary"


def _emit_probes(batches: Iterator[pa.RecordBatch], shards: int, least: int, salts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[np.ndarray]] = []
        for text_hash, doc_id, text in zip(batch.column("text_hash"), batch.column("doc_id"), batch.column("text"), strict=True):
            _, at, h = key_hashes(text.as_py(), least)
            if len(at):
                own = NO_ID if (x := doc_id.as_py()) is None else x
                out.append([shard_numbers(h, shards), np.full(len(at), text_hash.as_py() % salts), np.ones(len(at)), np.full(len(at), own), np.full(len(at), text_hash.as_py()), at, h[:, 0].view(np.int64), h[:, 1].view(np.int64)])
        if out:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2
            arrays = [pa.array(c.astype(np.int64), pa.int64()).cast(k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(cols[0]), pa.binary()) for _ in ARRAYS)], names=[x.split()[0] for x in MIXED.split(", ")])


def _probe_sorted(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows by shard and salt, a shard's arrays before its probes: one shard is held at a time."""
    held: Shard | None = None
    at: tuple[int, int] | None = None
    for batch in batches:
        shard, salt, kind = (batch.column(c).to_numpy() for c in ("shard", "salt", "kind"))
        starts = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)]) if len(shard) else []
        for begin, end in zip(starts, [*starts[1:], len(shard)], strict=True):
            if kind[begin] == 0:
                held, at = Shard(*(batch.column(c)[int(begin)].as_py() for c in ARRAYS)), (shard[begin], salt[begin])
            elif at == (shard[begin], salt[begin]):
                part = batch.slice(begin, end - begin)
                hashes = np.column_stack([part.column(c).to_numpy() for c in ("a", "b")]).view(np.uint64)
                count, keeper = held.probe(hashes)
                drop = pa.array((count >= least_docs) & (keeper != part.column("doc_id").to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(drop) for c in ("doc_id", "text_hash", "line")], names=["doc_id", "text_hash", "line"])


def _apply_drops(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        drops = [x or [] for x in batch.column("__drops").to_pylist()]
        yield _outcome(batch.select([c for c in batch.schema.names if c != "__drops"]), drops, texts)


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, texts: bool = False, broadcast_bytes: int = 48 << 20, keys_per_shard: int = 50_000, rows_per_salt: int = 2_000_000) -> DataFrame:
    """Drop the lines whose key is in ``least_docs`` documents or more, save in the
    largest doc_id that holds it.

    A text splits at line feeds; a line's key is the line without ASCII white space at
    both ends, A-Z in lower case, if that has ``least_chars`` code points.
    ``texts=False``: doc_id, n_lines, n_dropped, kept_sha256. ``texts=True``: the
    columns of ``docs`` with ``text`` rewritten.

    A null or empty text is one empty line (and rewritten, an empty text). Each row is
    one document in the counts; rows that share the largest doc_id all keep the line, and
    a null doc_id is the smallest. Columns of any other name pass through. An empty
    table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    if least_docs < 2:
        raise ValueError("least_docs must be at least 2")
    index, shards, size, hottest = build_index(docs, least_chars, keys_per_shard)
    rows = docs if texts else docs.select("doc_id", "text")
    schema = docs.schema if texts else "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([tuple(x) for x in index.collect()])
        return rows.mapInArrow(partial(_probe_broadcast, index=held, shards=shards, least=least_chars, least_docs=least_docs, texts=texts), schema)
    salts = max(1, min(4096, -(-hottest // rows_per_salt)))
    keyed = rows.withColumn("__own", F.coalesce(F.col("doc_id"), F.lit(NO_ID))).withColumn("__hash", F.xxhash64("text"))
    probes = keyed.selectExpr("__own as doc_id", "__hash as text_hash", "text").mapInArrow(partial(_emit_probes, shards=shards, least=least_chars, salts=salts), MIXED)
    served = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in MIXED.split(", ")[3:8])), *ARRAYS)
    drops = probes.unionByName(served).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(partial(_probe_sorted, least_docs=least_docs), "doc_id long, text_hash long, line int")
    drops = drops.groupBy(F.col("doc_id").alias("__own"), F.col("text_hash").alias("__hash")).agg(F.collect_set("line").alias("__drops"))
    joined = keyed.join(drops, ["__own", "__hash"], "left").select(*rows.columns, "__drops")
    return joined.mapInArrow(partial(_apply_drops, texts=texts), schema)
