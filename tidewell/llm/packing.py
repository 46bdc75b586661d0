"""Order-preserving packing of token streams into fixed windows.

Documents keep the order of their partition. Each block of consecutive documents is
cut by dynamic programming: ``best[j]`` is the least cost of cutting the stream at
candidate ``j``, where a window costs its padding and a cut costs nothing at the end
of a document, ``sentence_cost`` at the end of a sentence and ``split_cost``
elsewhere. Padding is linear in the two ends, so the least predecessor is a sliding
minimum of ``best[i] + position[i]``, which a monotone queue keeps in constant
amortised time.

The job is one map over the scan: no shuffle, and memory is bounded by a block plus
the longest document. A partition's windows depend on its rows alone, so a rerun of a
lost task yields the same rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.tokenizers import byte_bpe, default_path, encode_added, sentence_end_ids
from tidewell.session import prepare

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, step: int, sentence_cost: float, split_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions after the start of a stream, in order, with their costs. Stretches
    without an end of a sentence get a position every ``step`` tokens."""
    ends = np.union1d(doc_ends, sentence_ends)
    gaps = np.diff(np.concatenate(([0], ends)))
    extra = (gaps - 1) // step
    owner = np.repeat(np.arange(len(ends)), extra)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(extra) - extra, extra)
    filler = (ends - gaps)[owner] + (rank + 1) * step
    positions = np.concatenate((ends, filler))
    costs = np.concatenate((np.where(np.isin(ends, doc_ends), 0.0, sentence_cost), np.full(len(filler), split_cost)))
    order = np.argsort(positions, kind="stable")
    return positions[order], costs[order]


def best_cuts(positions: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Window ends of least total padding plus cut costs. Neighbouring positions must
    be at most ``window`` apart; the last one ends the stream."""
    at, cost = [0, *positions.tolist()], [0.0, *costs.tolist()]
    key, back = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        low = at[j] - window
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        key[j] = k = key[i] + window + cost[j]  # best[j] + at[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def split_tail(begin: int, end: int, window: int, split_cost: float) -> list[int]:
    """Ends of the windows for a block's last stretch. Sequences of a power of two need
    no padding, so a short tail is cut by its binary digits where that is cheaper."""
    n = end - begin
    if n & (n - 1) == 0 or window - n <= (n.bit_count() - 1) * split_cost:
        return [end]
    cuts, at = [], begin
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return cuts


def pack_block(docs: list[tuple[int | None, np.ndarray]], is_end: np.ndarray, window: int, step: int, sentence_cost: float, split_cost: float) -> dict[str, np.ndarray]:
    """Pieces of one block; ``sequence`` counts from 0."""
    ids = np.concatenate([x for _, x in docs])
    ends = np.cumsum([len(x) for _, x in docs])
    positions, costs = candidates(ends, np.flatnonzero(is_end[ids]) + 1, step, sentence_cost, split_cost)
    cuts = best_cuts(positions, costs, window)
    last = cuts[-2] if len(cuts) > 1 else 0
    cuts = np.array(cuts[:-1] + split_tail(last, cuts[-1], window, split_cost))
    piece_ends = np.union1d(cuts, ends)
    starts = np.concatenate(([0], piece_ends[:-1]))
    doc = np.searchsorted(ends, starts, side="right")
    seq = np.searchsorted(cuts, starts, side="right")
    seq_start = np.concatenate(([0], cuts[:-1]))
    sizes = np.diff(np.concatenate(([0], ends)))
    raw = ids.astype("<u4", copy=False)
    return {
        "doc": doc,
        "start": starts - (ends - sizes)[doc],
        "length": piece_ends - starts,
        "ids_crc32": np.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts.tolist(), piece_ends.tolist(), strict=True)], np.int64),
        "doc_tokens": sizes[doc],
        "sequence": seq,
        "offset": starts - seq_start[seq],
        "sequence_tokens": np.diff(np.concatenate(([0], cuts)))[seq],
    }


def _pack_partition(batches: Iterator[pa.RecordBatch], ranks_path: str, window: int, end_id: int, step: int, sentence_cost: float, split_cost: float, block_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoding, is_end = byte_bpe(ranks_path), sentence_end_ids(ranks_path)
    base = TaskContext.get().partitionId() << 40
    block: list[tuple[int | None, np.ndarray]] = []
    held = done = 0

    def flush() -> pa.RecordBatch:
        nonlocal done
        out = pack_block(block, is_end, window, step, sentence_cost, split_cost)
        names = [x for x, _ in block]
        doc_id = pa.array(names, pa.int64()).take(pa.array(out["doc"]))
        sequence = out["sequence"] + (base + done)
        done += int(out["sequence"][-1]) + 1
        cols = [out["start"], out["length"], out["ids_crc32"], out["doc_tokens"], sequence, out["offset"], out["sequence_tokens"]]
        return pa.RecordBatch.from_arrays([doc_id, *(pa.array(c, pa.int64()) for c in cols)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = np.append(encode_added(encoding, text.as_py()), np.uint32(end_id))
            block.append((doc_id.as_py(), ids))
            held += len(ids)
            if held >= block_tokens:
                yield flush()
                block, held = [], 0
    if block:
        yield flush()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, window: int = 1024, end_id: int = 0, step: int = 8, sentence_cost: float = 1.0, split_cost: float = 4.0, block_tokens: int = 1 << 20) -> DataFrame:
    """Pack whole texts into sequences of at most ``window`` tokens.

    One row per piece: ``doc_id``, ``start`` (ids of the document before it),
    ``length``, ``ids_crc32`` (of little-endian 32-bit ids), ``doc_tokens`` (with the
    closing ``end_id``), ``sequence_id``, ``offset`` in the sequence and
    ``sequence_tokens``. Sequences are to be padded to ``window``, save those whose
    length is a power of two.

    A null or empty text is the single id ``end_id``. Rows that share a doc_id, or a
    null one, are documents of their own. Other columns of ``docs`` are not read. An
    empty table gives no rows. Sequence ids are unique, and rise with the order of
    partitions and rows, but are not consecutive across partitions.
    """
    if step > window:
        raise ValueError("step must be at most window")
    prepare(docs.sparkSession)
    run = partial(_pack_partition, ranks_path=ranks_path or default_path("byte_bpe_50k.tiktoken"), window=window, end_id=end_id, step=step, sentence_cost=sentence_cost, split_cost=split_cost, block_tokens=block_tokens)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)
