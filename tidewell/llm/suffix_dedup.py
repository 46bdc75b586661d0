"""Repeated passages by an enhanced suffix array over sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere.
Suffixes are sampled by content: of the ``GRAM``-byte strings in each window of
``LENGTH`` bytes the one of least hash (the leftmost of equals) is an anchor. Equal windows
have their anchors at equal places, so every repeated window is seen at an anchor that
two occurrences share, and about one suffix in eighty is enough.

1. A map over the scan gives each anchor its gram's hash, and a hash of its context: all
   the bytes that windows around the anchor can reach.
2. Anchors whose gram occurs once are dropped. Where one context occurs twice, all its
   windows are repeated; inside long repeats every anchor is of this kind, and copies
   are only ever counted (with map-side combine), however many there are.
3. For grams with several contexts, one occurrence of each context is fetched. Per gram,
   the suffixes at the anchors are sorted, with the lengths of common prefixes of
   neighbours; a stack scan of these lengths gives the tree of common-prefix intervals.
   In each interval the left contexts are compared: where they are not all alike, the
   members part into maximal repeats, each of which is reported with every occurrence.
   A gram with more than ``HOT`` contexts is split by further bytes: two contexts of one
   window agree on many bytes to the right of the gram or on many to the left of it, so
   they meet in the group of these bytes; groups are split until they are small, and the
   tree decides in each. Only contexts that all agree on a whole window, and are still
   more than ``HOT``, have their windows counted by hash.
4. Spans are merged per document and cut out in a last map over the scan.

``repeat_groups`` puts out the repeats themselves, with all occurrences.

Contexts are compared byte by byte in step 3 and by 64-bit hashes within one gram in step 2.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise, prepare

LENGTH, GRAM = 200, 40
LEFT = LENGTH - GRAM  # bytes before an anchor that a window can reach
WIDTH = LEFT + LENGTH
CHUNK = 1 << 19
HOT = 100_000
ROWS_PER_SALT = 4096  # anchors of one gram to a salt
NO_ID = -(1 << 63)
BROADCAST_BYTES = 64 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64)

# --- anchors ----------------------------------------------------------------------


@functools.lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 2^bits + 1 of each."""
    n = (1 << bits) + 1
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(np.full(n - 1, MULTIPLIER), out=up[1:])
    np.multiply.accumulate(np.full(n - 1, INVERSE), out=down[1:])
    return up, down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least value of each run of ``width`` values, leftmost of equals.

    With blocks of ``width``, a run's minimum is the lesser of a suffix minimum of one
    block and a prefix minimum of the next.
    """
    n = len(h)
    pad = -n % width
    blocks = np.concatenate((h, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - width + 1], before[width - 1 : n])
    # candidates: places whose value is the minimum of some run that holds them
    change = np.concatenate(([True], least[1:] != least[:-1]))
    begins = np.flatnonzero(change)
    ends = np.append(begins[1:], len(least))
    out = []
    for b, e, value in zip(begins.tolist(), ends.tolist(), least[begins], strict=True):
        places = np.flatnonzero(h[b : e + width - 1] == value) + b
        if len(places) > 1:  # a place counts if it is leftmost in some run of b..e-1
            first = np.maximum(np.append(b, places[:-1] + 1), places - width + 1)
            last = np.minimum(places, e - 1)
            places = places[first <= last]
        out.append(places)
    return np.unique(np.concatenate(out))


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and context hashes of a text's anchors, by chunks."""
    n = len(raw)
    if n < LENGTH:
        empty = np.empty(0, np.uint64)
        return empty.astype(np.int64), empty, empty
    all_bytes = np.frombuffer(raw, np.uint8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, n - LENGTH + 1, CHUNK):
        end = min(begin + CHUNK, n - LENGTH + 1)  # starts of windows
        low, high = max(0, begin - LEFT), min(n, end + 2 * LENGTH)
        part = BYTE_VALUES[all_bytes[low:high]]
        up, down = _powers(max(10, (high - low).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        first = begin - low
        stop = end - low + LENGTH - GRAM  # starts of grams
        at = np.arange(first, stop)
        grams = _mix((sums[first + GRAM : stop + GRAM] - sums[first:stop]) * down[first:stop])
        own = at[_leftmost_minima(grams, LEFT + 1)]
        left = np.maximum(own + low - LEFT, 0) - low
        right = np.minimum(own + low + LENGTH, n) - low
        context = _mix(_mix((sums[right] - sums[left]) * down[left]) + (own - left).astype(np.uint64) * np.uint64(1000003) + (right - own).astype(np.uint64))
        found.append((own + low, grams[own - first], context))
    place, gram, context = (np.concatenate(x) for x in zip(*found, strict=True))
    place, once = np.unique(place, return_index=True)
    return place, gram[once], context[once]


ANCHORS = "doc long, text_hash long, place long, gram long, context long"


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows: list[list[np.ndarray]] = []
            part = batch.slice(at, 1000)
            for doc, text_hash, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                place, gram, context = anchors((text.as_py() or "").encode())
                if len(place):
                    rows.append([np.full(len(place), doc), np.full(len(place), text_hash), place, gram.view(np.int64), context.view(np.int64)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in ANCHORS.split(", ")])


# --- contexts ---------------------------------------------------------------------

CONTEXTS = "gram long, context long, doc long, text_hash long, place long, before int, after int, bytes binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, of one width: bytes 0 stand where the text ends."""
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
    for batch in batches:
        rows = []
        for doc, text_hash, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
            raw = (text.as_py() or "").encode()
            for x in wanted.as_py():
                place = x["place"]
                before, after = min(place, LEFT), min(len(raw) - place, LENGTH)
                context = b"\0" * (LEFT - before) + raw[place - before : place + after] + b"\0" * (LENGTH - after)
                rows.append((x["gram"], x["context"], doc, text_hash, place, before, after, context))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


# --- the interval tree --------------------------------------------------------------


def agreement(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a and of b, up to ``most``."""
    differ = a != b
    length = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(length, most)


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Intervals (depth, first, last) of a suffix array: the maximal runs of at least two
    suffixes whose neighbours share ``depth`` bytes, deepest first, by a stack scan.
    ``lcp[i]`` belongs to suffixes i-1 and i; ``lcp[0]`` is not read."""
    stack: list[tuple[int, int]] = []  # depth, first
    for i in range(1, len(lcp) + 1):
        depth, first = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(right: np.ndarray, left: np.ndarray, after: np.ndarray, before: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of occurrences from contexts around one gram.

    ``right``: bytes from the anchors on; ``left``: bytes before them, nearest first;
    ``after`` and ``before``: how many of them are of the text. Yields depth, members
    and the most left bytes that each has in common with another member, for members
    where both together reach ``length``.
    """
    order = np.ascontiguousarray(right).view(f"S{right.shape[1]}").ravel().argsort(kind="stable")
    sorted_right, most = right[order], after[order]
    lcp = [0, *agreement(sorted_right[1:], sorted_right[:-1], np.minimum(most[1:], most[:-1])).tolist()]
    rank = np.empty(len(order), np.int64)
    rank[np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel().argsort(kind="stable")] = np.arange(len(order))
    for depth, first, last in prefix_intervals(lcp):
        members = order[first : last + 1]
        members = members[rank[members].argsort()]
        near, far = members[:-1], members[1:]
        shared = agreement(left[near], left[far], np.minimum(before[near], before[far]))
        # unless all left contexts agree, neighbours in left order part into different repeats
        widest = np.maximum(np.append(shared, 0), np.append(0, shared))
        enough = widest + depth >= length
        if enough.any():
            yield depth, members[enough], widest[enough]


SPANS = "doc long, text_hash long, low long, high long"
GROUPS = "gram long, number int, context long, low int, high int"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by ``key``: a task holds a batch and the group that
    goes on into the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and key[0] != held[-1].column("key")[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _intervals(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Members (numbers of rows), bytes before their anchors and bytes from these on, of
    each maximal repeat of ``LENGTH`` bytes or more within a group; groups of two all at once."""
    key = rows["key"].to_numpy()
    matrix = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8).reshape(len(key), WIDTH)
    before, after = (rows[c].to_numpy().astype(np.int64) for c in ("before", "after"))
    right, left = matrix[:, LEFT:], matrix[:, :LEFT][:, ::-1]
    begins = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    sizes = np.diff(begins)
    two = begins[:-1][sizes == 2]  # a tree of one interval: all such groups at once
    if len(two):
        depth = agreement(right[two], right[two + 1], np.minimum(after[two], after[two + 1]))
        shared = agreement(left[two], left[two + 1], np.minimum(before[two], before[two + 1]))
        good = depth + shared >= LENGTH
        both = np.column_stack((two, two + 1))[good].ravel()
        yield both, np.repeat(shared[good], 2), np.repeat(depth[good], 2)
    for b, e in zip(begins[:-1][sizes > 2].tolist(), begins[1:][sizes > 2].tolist(), strict=True):
        for depth, own, shared in maximal_repeats(right[b:e], left[b:e], after[b:e], before[b:e], LENGTH):
            yield own + b, shared, np.full(len(own), depth)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeats from contexts sorted by group."""
    for rows in _grams(batches):
        found = list(_intervals(rows))
        if found and sum(len(x[0]) for x in found):
            at, shared, depth = (np.concatenate(x) for x in zip(*found, strict=True))
            place = rows["place"].to_numpy().astype(np.int64)[at]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([rows["doc"].combine_chunks().take(take), rows["text_hash"].combine_chunks().take(take), pa.array(place - shared), pa.array(place + depth)], names=["doc", "text_hash", "low", "high"])


def alike(bytes_: np.ndarray, low: int, high: int) -> np.ndarray:
    """Numbers of the classes of rows that agree in columns low..high-1."""
    if high <= low:
        return np.zeros(len(bytes_), np.int64)
    return np.unique(np.ascontiguousarray(bytes_[:, low:high]).view(f"V{high - low}").ravel(), return_inverse=True)[1]


def diverse(column: np.ndarray, inside: np.ndarray) -> bool:
    """Whether the bytes next to a string differ, or one occurrence ends there: it cannot be
    extended. ``inside``: whether the window and the text go on."""
    return not inside.all() or bool((column[1:] != column[0]).any())


def _scan_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats, numbered within their gram: each member's context and the bytes
    of the repeat before and from its anchor on."""
    for rows in _grams(batches):
        gram, context = rows["key"].to_numpy(), rows["context"].to_numpy()
        matrix = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8).reshape(len(gram), WIDTH)
        before, after = rows["before"].to_numpy(), rows["after"].to_numpy()
        numbers: dict[int, int] = {}
        out: list[tuple[int, int, int, int, int]] = []
        for at, shared, depth in _intervals(rows):
            # members of one interval that agree on as many bytes to the left are one repeat
            for g, s, d in sorted(set(zip(gram[at].tolist(), shared.tolist(), depth.tolist(), strict=True))):
                own = at[(gram[at] == g) & (shared >= s) & (depth == d)]
                classes = alike(matrix[own], LEFT - s, LEFT)
                for c in np.unique(classes):
                    members = own[classes == c]
                    if len(members) > 1 and diverse(matrix[members, max(LEFT - s - 1, 0)], before[members] > s) and diverse(matrix[members, min(LEFT + d, WIDTH - 1)], after[members] > d):
                        numbers[g] = numbers.get(g, -1) + 1
                        out += [(g, numbers[g], int(context[m]), s, d) for m in members.tolist()]
        if out:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in GROUPS.split(", ")])


def _split(rows: DataFrame) -> DataFrame:
    """Groups by further bytes. Members of a group agree on ``a`` bytes from their anchors
    on and ``b`` before them. Two that share a window of ``LENGTH`` bytes agree on m or
    more to the right, or on LENGTH + 1 - m or more to the left: they meet in one of two
    groups. Groups of one are dropped."""
    m = F.ceil((F.col("a") + LENGTH - F.col("b")) / 2).cast("int")
    rows = rows.withColumn("m", m).withColumn("l", F.lit(LENGTH + 1) - F.col("m"))
    right = rows.where("after >= m").withColumn("key", F.xxhash64("key", F.lit(0), F.substring("bytes", F.lit(LEFT + 1), F.col("m")))).withColumn("a", F.col("m"))
    left = rows.where((F.col("before") >= F.col("l")) & (F.col("l") <= LEFT)).withColumn("key", F.xxhash64("key", F.lit(1), F.substring("bytes", F.lit(LEFT + 1) - F.col("l"), F.col("l")))).withColumn("b", F.col("l"))
    both = materialise(right.unionByName(left).drop("m", "l", "size"), "anchor-split")
    sizes = both.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("size")).where("size > 1")
    return materialise(both.join(sizes, F.col("key") == F.col("k")).drop("k"), "anchor-groups")


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """Spans for groups of very many contexts that agree on a whole window: each window's
    hash is counted, with map-side combine, and windows found twice go back to their
    occurrences."""
    offsets = F.sequence(F.lit(0), F.lit(LEFT))
    window = lambda o: F.struct(o.alias("offset"), F.xxhash64(F.substring("bytes", F.lit(LEFT + 1) - o, F.lit(LENGTH))).alias("window"))
    inside = lambda o: (o <= F.col("before")) & (F.lit(LENGTH) - o <= F.col("after"))
    rows = contexts.select("key", "doc", "text_hash", "place", F.inline(F.transform(F.filter(offsets, inside), window)))
    twice = rows.groupBy("key", "offset", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(twice, ["key", "offset", "window"], "left_semi").select("doc", "text_hash", (F.col("place") - F.col("offset")).alias("low"), (F.col("place") - F.col("offset") + LENGTH).alias("high"))


def _tree_spans(fetched: DataFrame, sizes: DataFrame) -> DataFrame:
    """Spans from contexts (``CONTEXTS``); sizes: gram, count of its contexts."""
    tree = lambda rows: rows.repartition("key").sortWithinPartitions("key").mapInArrow(_scan, SPANS)
    columns = ["key", "doc", "text_hash", "place", "before", "after", "bytes"]
    keyed = fetched.withColumnRenamed("gram", "key")
    hot = materialise(sizes.where(F.col("count") > HOT).select(F.col("gram").alias("g")), "anchor-hot")
    if not hot.head(1):
        return tree(keyed.select(*columns))
    keyed = materialise(keyed, "anchor-bytes")
    spans = tree(keyed.join(_sized(hot, 32), F.col("key") == F.col("g"), "left_anti").select(*columns))
    rows = keyed.join(_sized(hot, 32), F.col("key") == F.col("g"), "left_semi").select(*columns, F.lit(GRAM).alias("a"), F.lit(0).alias("b"))
    while rows.head(1):
        rows = _split(rows)
        spans = spans.unionByName(tree(rows.where(F.col("size") <= HOT).select(*columns)))
        large = rows.where(F.col("size") > HOT)
        spans = spans.unionByName(_hot_spans(large.where(F.col("a") + F.col("b") >= LENGTH)))
        rows = large.where(F.col("a") + F.col("b") < LENGTH)
    return spans


# --- spans per document ---------------------------------------------------------------


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans (n x 2), those that touch or overlap made one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    begins = np.flatnonzero(new)
    return np.column_stack((spans[begins, 0], reach[np.append(begins[1:], len(spans)) - 1]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for low, high in zip(batch.column("lows"), batch.column("highs"), strict=True):
            out.append(merged(np.column_stack((low.values.to_numpy(), high.values.to_numpy()))).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_hash"), pa.array(out, pa.binary())], names=["doc", "text_hash", "spans"])


def _sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """A table to be joined: broadcast if its counted size is within bounds."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _anchored(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors whose gram occurs twice or more, with ``salts``; and of grams with several
    contexts these, with the number and one of their occurrences. A gram with very many
    anchors has several salts, to which its anchors are dealt."""
    found = materialise(keyed.select("doc_id", "text_hash", "text").mapInArrow(_emit_anchors, ANCHORS), "anchors")
    # a table of its own, so that the join has an exchange on both sides and a gram with very many anchors can be split
    salts = F.least(F.lit(256), F.ceil(F.col("n") / ROWS_PER_SALT)).cast("int").alias("salts")
    grams = materialise(found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("n > 1").select(F.col("gram").alias("g"), (F.col("lo") != F.col("hi")).alias("several"), salts), "anchor-grams")
    twice = materialise(found.join(grams, F.col("gram") == F.col("g")).drop("g"), "anchors-twice")
    contexts = twice.where("several").groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "text_hash", "place")).alias("one"), F.max("salts").alias("salts"))
    return twice, materialise(contexts, "anchor-contexts")


def _occurrences(anchors_: DataFrame, contexts: DataFrame) -> DataFrame:
    """Anchors joined with rows by (gram, context), hot grams being served in salted copies."""
    served = contexts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumnsRenamed({"gram": "g", "context": "c"})
    dealt = anchors_.withColumn("own_salt", F.pmod(F.hash("doc", "place"), "salts"))
    return dealt.join(served, (F.col("gram") == F.col("g")) & (F.col("context") == F.col("c")) & (F.col("own_salt") == F.col("salt"))).drop("g", "c", "salt", "own_salt")


def _fetched(keyed: DataFrame, contexts: DataFrame) -> DataFrame:
    """The bytes of one occurrence of each context."""
    wanted = contexts.groupBy(F.col("one.doc").alias("d"), F.col("one.text_hash").alias("t")).agg(F.collect_list(F.struct("one.place", "gram", "context")).alias("wanted"))
    wanted = F.broadcast(wanted) if contexts.count() * 40 <= BROADCAST_BYTES else wanted
    return keyed.join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("t"))).select("doc_id", "text_hash", "text", "wanted").mapInArrow(_fetch, CONTEXTS)


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """doc, text_hash, spans (pairs of int64) of the texts with a repeat; ``keyed`` has
    doc_id (not null), text_hash and text. Spans may reach past a text's ends."""
    twice, contexts = _anchored(keyed)
    whole = lambda df: df.select("doc", "text_hash", F.greatest(F.col("place") - LEFT, F.lit(0)).alias("low"), (F.col("place") + LENGTH).alias("high"))
    again = contexts.where("n > 1").select("gram", "context", "salts")
    spans = whole(twice.where("not several")).unionByName(whole(_occurrences(twice.where("several"), again)))
    spans = spans.unionByName(_tree_spans(_fetched(keyed, contexts), contexts.groupBy("gram").count()))
    return spans.groupBy("doc", "text_hash").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")).mapInArrow(_merge, "doc long, text_hash long, spans binary")


def repeat_groups(docs: DataFrame) -> DataFrame:
    """The maximal repeats with all their occurrences: gram, number (both name a repeat),
    doc_id, low and high (bytes of the text), one row per occurrence.

    Repeats of ``LENGTH`` bytes or more are seen through a window of ``WIDTH`` bytes around
    each anchor: a repeat that fills the window at an anchor is cut to it there, and goes on in
    the groups of the next anchors; bytes covered by all groups are those that
    ``dedup_passages`` removes. Texts that are alike whole, row by row, are occurrences of
    their own. Nulls and empty texts have none; a null doc_id stays null. Grams of more
    than ``HOT`` contexts are gathered here: a listing of all occurrences is as large.
    """
    prepare(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    twice, contexts = _anchored(keyed)
    tree = _fetched(keyed, contexts).withColumnRenamed("gram", "key").repartition("key").sortWithinPartitions("key").mapInArrow(_scan_groups, GROUPS)
    # a context that occurs twice is a repeat, too, as wide as the window
    whole = contexts.where("n > 1").select("gram", F.lit(-1).alias("number"), "context", F.lit(LEFT).alias("low"), F.lit(LENGTH).alias("high"), "salts")
    several = _occurrences(twice.where("several"), tree.join(contexts.select("gram", "context", "salts"), ["gram", "context"]).select(*whole.columns).unionByName(whole))
    alone = twice.where("not several").select("*", F.lit(-1).alias("number"), F.lit(LEFT).alias("low"), F.lit(LENGTH).alias("high"))
    columns = ["doc", "text_hash", "place", "gram", "context", "number", "low", "high"]
    found = several.select(*columns).unionByName(alone.select(*columns))
    sized = keyed.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.octet_length("text").alias("n")).distinct()
    joined = found.join(sized, (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("t")))
    low, high = F.greatest(F.col("place") - F.col("low"), F.lit(0)), F.least(F.col("place") + F.col("high"), F.col("n").cast("long"))
    return joined.select("gram", F.when(F.col("number") < 0, F.xxhash64("context")).otherwise(F.col("number").cast("long")).alias("number"), F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), low.alias("low"), high.alias("high"))


def _clipped(spans: bytes | None, n: int) -> list[tuple[int, int]]:
    if not spans:
        return []
    found = np.clip(np.frombuffer(spans, np.int64).reshape(-1, 2), 0, n)
    return [(a, b) for a, b in found.tolist() if a < b]


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to the borders of UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, kept = [], []
        for text, spans in zip(batch.column("text"), batch.column("__spans"), strict=True):
            raw = (text.as_py() or "").encode()
            gone = _clipped(spans.as_py(), len(raw))
            if texts:
                gone = whole_characters(raw, gone)
            edges = [0, *(x for span in gone for x in span), len(raw)]
            left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            if texts:
                kept.append(text.as_py() if not gone else left.decode())
            else:
                rows.append((len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest()))
        if texts:
            names = [c for c in batch.schema.names if c != "__spans"]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)
        elif rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_passages(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Cut out the bytes covered by a 200-byte string that also starts elsewhere, in
    another document or the same.

    ``texts=False``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256. ``texts=True``: the columns of ``docs`` with ``text`` cut, spans being
    drawn in to whole characters.

    Texts are taken as UTF-8; a null is empty (and stays null with ``texts``). Matches
    do not cross rows. Repeated rows are occurrences of their own, so both go. Null
    ids are allowed. Columns of other names pass through or are not read. An empty
    table gives an empty one.
    """
    prepare(docs.sparkSession)
    keyed = docs.withColumn("__own", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__hash", F.xxhash64("text"))
    spans = materialise(repeated_spans(keyed.select(F.col("__own").alias("doc_id"), F.col("__hash").alias("text_hash"), "text")), "spans")
    rows = list(docs.columns) if texts else ["doc_id", "text"]
    # about 48 bytes a document with a few spans
    joined = keyed.join(_sized(spans.select(F.col("doc").alias("__d"), F.col("text_hash").alias("__t"), F.col("spans").alias("__spans")), 80), (F.col("__own") == F.col("__d")) & (F.col("__hash") == F.col("__t")), "left")
    schema = docs.schema if texts else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = joined.select(*([F.col(c) for c in rows] if texts else [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]), "__spans")
    return out.mapInArrow(partial(_cut, texts=texts), schema)
