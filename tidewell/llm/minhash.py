"""Near-duplicate documents: MinHash bands, signatures, full sets, components.

1. A map over the scan gives each document the fingerprint of its shingle set and a
   signature of many universal hash minima. Documents of one set form a class, which is
   numbered; from there on classes are compared, never documents or their ids, so rows
   that share a doc_id stay apart and copies never meet again until the end.
2. Signatures are cut into bands; classes that agree on a band share a bucket. Each
   member of a bucket is compared, on full sets, with one pivot only, so a bucket costs
   as many comparisons as it has members. Links give components.
3. Two members of a bucket that are still in different components may be linked past the
   pivot. Such pairs have a member outside the bucket's largest component, the minority,
   and are looked for inside tasks that hold a block of the minority and a block of the
   bucket: signatures that cannot belong to a link are passed over, the others are
   compared on full sets. Pairs are neither written nor shuffled; only links between
   components leave a task. A pair is looked at in its first common bands.
4. A bucket whose minority is more than one block meets ``PIVOTS`` further pivots a turn, as
   long as these find links: near copies of one text come together. What stays apart is
   split by each later band: a linked pair agrees on many bands, so it meets again in a
   smaller group, and texts that share one passage part. A minority that is still large
   after ``LEVELS`` bands is dealt out in blocks, each with every block of its group.
5. Components over all links, by large-star and small-star.

The chance that a pair at the threshold shares no band is (1 - s^rows)^bands, 5e-8 for
s = 0.8 and 1e-10 for 0.85; that it shares one band only, and could be missed in a bucket
that is split, 1e-6 and 2e-9. A signature estimate is passed over if it lies more than
six standard deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.session import materialise, prepare

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BLOCK = 1024
LEVELS, TURNS, PIVOTS = 3, 3, 8  # bands that name a group at most; turns at each level; pivots a turn
BROADCAST_BYTES = 64 << 20
_RNG = np.random.default_rng(20240229)
FACTORS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the word windows of a text. Fewer words make
    one shingle, no words none."""
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words_of(text)], np.uint64)
    if not len(w):
        return w
    if len(w) < size:
        return np.array([digest(w.tobytes(), seed=len(w))], np.uint64)
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def signature(own: np.ndarray) -> np.ndarray:
    """Minima (uint32) of multiply-shift hashes over a set that is not empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        least = np.minimum(least, (own[at : at + 2048, None] * FACTORS + SHIFTS).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key per band (n x BANDS); different bands have different keys."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), (len(s), 1))
    for k in range(ROWS):
        h = (h ^ s[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


SKETCH = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, signature binary"
NOT_EMPTY = "doc_id is not null and f1 is not null"


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
    return int(a), int(b)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    names, kinds = [x.split()[0] for x in SKETCH.split(", ")], [*[pa.int64()] * 3, pa.binary()]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            own = shingles(text.as_py(), size)
            rows.append((len(own), *fingerprint(own), signature(own).tobytes()) if len(own) else (0, None, None, None))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def signatures_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), np.uint32) for x in batch["signature"]])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(signatures_of(batch))
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["band", "key", "node"])


def _later_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of groups again, in groups that agree on one band more."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            keys, first = band_keys(signatures_of(part)), part.column("band").to_numpy()
            old = part.column("key").to_numpy().view(np.uint64)
            row, band = np.nonzero(np.arange(BANDS) > first[:, None])
            key = (old[row] ^ (old[row] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + keys[row, band]
            yield pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(part.column("node").to_numpy()[row])], names=["band", "key", "node"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sets of those texts that have the fingerprint asked for: an id may name several."""
    for batch in batches:
        nodes, sets = [], []
        for text, node, f1, f2 in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("node", "f1", "f2")), strict=True):
            own = shingles(text.as_py(), size)
            if len(own) and fingerprint(own) == (f1, f2):
                nodes.append(node)
                sets.append(own.view(np.int64))
        ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["node", "own"])


# --- pairs inside a task ------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for begin, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            key = tuple(c[begin] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


GROUP = ("key", "left", "right")


def open_pairs(group: pa.Table, least: float) -> Iterator[tuple[int, int]]:
    """Rows of a group that may be linked across components: of the group's two blocks,
    in their first common bands, with signatures that agree enough."""
    comp, block = group["component"].to_numpy(), group["block"].to_numpy()
    if (comp == comp[0]).all():
        return
    band, level, left, right = (group[c][0].as_py() for c in ("band", "level", "left", "right"))
    sig = signatures_of(group)
    keys = band_keys(sig)[:, :band]
    rows, cols = np.flatnonzero(block == left), np.flatnonzero(block == right)
    for i in rows.tolist():
        other = cols[cols > i] if left == right else cols
        other = other[comp[other] != comp[i]]
        if len(other):
            close = (sig[other] == sig[i]).sum(axis=1) >= least
            other = other[close]
            other = other[(keys[other] == keys[i]).sum(axis=1) <= level]
            for j in other.tolist():
                yield i, j


DEALT = "key long, left int, right int, band int, level int, block int, node long, component long, signature binary"


def _needed(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Members of a group that have a pair to be looked at."""
    for group in _groups(batches, GROUP):
        own = sorted({x for pair in open_pairs(group, least) for x in pair})
        if own:
            out = group.select([x.split()[0] for x in DEALT.split(", ")]).take(pa.array(own))
            yield from out.combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch], least: float, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links between components of a group; once two are linked their other pairs are left."""
    for group in _groups(batches, GROUP):
        comp = group["component"].to_pylist()
        sets = [np.frombuffer(x.values.to_numpy(), np.int64) if x.is_valid else np.empty(0, np.int64) for x in group["own"]]
        parent = {c: c for c in comp}

        def root(c: int, parent=parent) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        u, v = [], []
        for i, j in open_pairs(group, least):
            a, b = root(comp[i]), root(comp[j])
            if a != b:
                n, m = len(sets[i]), len(sets[j])
                if den * min(n, m) < num * max(n, m):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both >= num * (n + m - both):
                    parent[max(a, b)] = min(a, b)
                    u.append(comp[i])
                    v.append(comp[j])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


# --- the operator -------------------------------------------------------------------


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table, counted, is small enough to go to every executor."""
    return df.count() * row_bytes <= limit


def join_ids(big: DataFrame, ids: DataFrame, on: Column, how: str) -> DataFrame:
    """Join a large table with a list of ids: by broadcast if that is small, else by shuffle."""
    return big.join(F.broadcast(ids) if small_enough(ids, 64) else ids, on, how)


def verdicts(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = materialise(own.mapInArrow(partial(_sketch, size=size), SKETCH), "minhash")
    one = rows.where(NOT_EMPTY).groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "signature")).alias("x"))
    # numbers are unique in one job and fixed by writing them
    classes = materialise(one.select("f1", "f2", F.col("x.doc_id").alias("rep"), "x.signature", F.monotonically_increasing_id().alias("node")), "minhash-classes")
    groups = materialise(components(links(own, classes, size, num, den)), "minhash-components")
    linked = groups.join(classes.select("node", "rep"), "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = classes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "node", "rep").join(linked.join(least, "component").select("node", "component_id"), "node", "left")
    out = rows.drop("signature").join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents with ``den`` * intersection >= ``num`` * union of their sets of
    ``size``-word shingles are linked; component_id is the least doc_id reachable, and
    the document of that id is kept. A text of fewer words is one shingle; a null or
    empty one has none and is linked with nothing.

    Rows with a null doc_id are linked with nothing, have a null component_id and are
    kept. Rows that share a doc_id are texts of their own: each has the component of its
    own text. Other columns are not read. An empty table gives no rows. Shingles are
    compared by 64-bit hashes.
    """
    return verdicts(docs, size, num, den).drop("text_hash")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose full sets make a link."""
    left, right = sets.select(F.col("node").alias("u"), F.col("own").alias("a")), sets.select(F.col("node").alias("v"), F.col("own").alias("b"))
    sized = pairs.join(left, "u").join(right, "v").select("u", "v", F.size("a").cast("long").alias("n"), F.size("b").cast("long").alias("m"), F.size(F.array_intersect("a", "b")).cast("long").alias("both"))
    return sized.where(den * F.col("both") >= num * (F.col("n") + F.col("m") - F.col("both"))).select("u", "v")


def _buckets(rows: DataFrame, name: str) -> DataFrame:
    """The rows (band, key, node) of keys that occur twice or more, with the least node."""
    twice = materialise(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").select(F.col("key").alias("k"), "pivot"), f"{name}-keys")
    return materialise(join_ids(rows, twice, F.col("key") == F.col("k"), "inner").select("band", "key", "pivot", "node"), name)


def _placed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (band, key, node) of groups of several components, with component, n and
    minority: whether the row, and how many rows, are outside the group's largest
    component. A group of one block at most is all minority."""
    own = rows.select("band", "key", "node").join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left").select("band", "key", "node", F.coalesce("component", "node").alias("component"))
    parts = own.groupBy("key", "component").agg(F.count("*").alias("n"))
    of_group = parts.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"))
    mixed = of_group.where("parts > 1").select("k", "n", F.when(F.col("n") > BLOCK, F.col("most.component")).alias("largest"), F.when(F.col("n") > BLOCK, F.col("n") - F.col("most.n")).otherwise(F.col("n")).alias("minority"))
    mixed = materialise(mixed, "minhash-mixed")
    joined = join_ids(own, mixed, F.col("key") == F.col("k"), "inner")
    return materialise(joined.select("band", "key", "node", "component", "n", "minority", F.coalesce(F.col("component") != F.col("largest"), F.lit(True)).alias("minor")), "minhash-open")


def _to_pivots(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (u, v) of different components: members of each group with ``PIVOTS`` members of it."""
    h = F.xxhash64("node", F.lit(turn))
    firsts = [F.min(F.when(F.pmod(h, F.lit(PIVOTS)) == i, F.col("node"))) for i in range(PIVOTS)]
    pivots = rows.groupBy(F.col("key").alias("k")).agg(F.array_compact(F.array(*firsts)).alias("p")).select("k", F.explode("p").alias("v"))
    pivots = pivots.join(rows.select(F.col("key").alias("own"), F.col("node").alias("w"), F.col("component").alias("theirs")), (F.col("k") == F.col("own")) & (F.col("v") == F.col("w")))
    met = rows.join(pivots, (F.col("key") == F.col("k")) & (F.col("component") != F.col("theirs")))
    return met.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in groups (left, right) of two blocks: each block of the minority with itself
    and with every other block of its group."""
    few, rest = F.ceil(F.col("minority") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("minority")) / BLOCK).cast("int")
    sized = rows.withColumn("few", few).withColumn("all", few + rest)
    block = F.when(F.col("minor"), F.pmod(F.hash("node"), "few")).otherwise(F.col("few") + F.pmod(F.hash("node"), F.greatest(F.col("all") - F.col("few"), F.lit(1))))
    others = F.sequence(F.lit(0), F.when(F.col("minor"), F.col("all")).otherwise(F.col("few")) - 1)
    dealt = sized.withColumn("block", block.cast("int")).withColumn("other", F.explode(others))
    return dealt.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "band", "level", "block", "node", "component")


def links(docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (u, v) between classes, enough of them that components are exact."""
    signatures = classes.select("node", "signature")
    rows = _buckets(signatures.mapInArrow(_bands, "band int, key long, node long"), "minhash-members")

    # full sets of the classes that share a bucket
    wanted = materialise(rows.select(F.col("node").alias("w")).distinct().join(classes, F.col("node") == F.col("w")).select("node", "rep", "f1", "f2"), "minhash-wanted")
    texts = join_ids(docs.select("doc_id", "text"), wanted, F.col("doc_id") == F.col("rep"), "inner").select("text", "node", "f1", "f2")
    sets = materialise(texts.mapInArrow(partial(_sets, size=size), "node long, own array<long>").dropDuplicates(["node"]), "minhash-sets")

    pairs = rows.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    found = materialise(confirmed(pairs, sets, num, den), "minhash-links")
    groups = materialise(components(found), "minhash-groups")
    settled = []
    for level in range(LEVELS):
        rows = _placed(rows, groups)
        large = rows.where(F.col("minority") > BLOCK)
        for turn in range(TURNS):
            if not large.head(1):
                break
            pairs = materialise(_to_pivots(large, turn), "minhash-pairs")
            asked = materialise(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "minhash-asked")
            new = materialise(confirmed(pairs, join_ids(sets, asked, F.col("node") == F.col("id"), "left_semi"), num, den), "minhash-links")
            if not new.head(1):
                break
            found = found.unionByName(new)
            groups = materialise(components(found), "minhash-groups")
            rows = _placed(rows, groups)
            large = rows.where(F.col("minority") > BLOCK)
        last = level == LEVELS - 1 or not large.head(1)
        settled.append((rows if last else rows.where(F.col("minority") <= BLOCK)).withColumn("level", F.lit(level)))
        if last:
            break
        rows = _buckets(large.select("band", "key", "node").join(signatures, "node").mapInArrow(_later_bands, "band int, key long, node long"), "minhash-members")

    # what the comparisons with pivots leave open
    floor = HASHES * (num / den - 6 * (num / den * (1 - num / den) / HASHES) ** 0.5)
    order = [*GROUP, "block", "node"]
    dealt = _dealt(reduce(DataFrame.unionByName, settled))
    needed = materialise(dealt.join(signatures, "node").repartition(*GROUP).sortWithinPartitions(*order).mapInArrow(partial(_needed, least=floor), DEALT), "minhash-needed")
    more = needed.join(sets, "node").repartition(*GROUP).sortWithinPartitions(*order).mapInArrow(partial(_links, least=floor, num=num, den=den), "u long, v long")
    return found.unionByName(more)


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose text is a near copy of a
    text with a smaller doc_id.

    A row goes by its own text: another text under the same doc_id does not take it
    along. Repeated rows stay or go together. Null texts, empty ones and rows with a null
    doc_id stay. Extra columns of any name pass through. An empty table gives an empty one.
    """
    gone = materialise(verdicts(docs, size, num, den).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_hash")).distinct(), "minhash-gone")
    return join_ids(docs, gone, (F.col("doc_id") == F.col("__gone")) & (F.xxhash64("text") == F.col("__gone_hash")), "left_anti")
