"""SentencePiece encoding and decoding by batched Viterbi in numpy, for unigram and BPE
model files.

Distinct words of equal length advance together. Prefix hashes give the hash of every
substring by one multiplication; a binary search in the pieces' sorted hashes gives its
piece and score. For each end position the best last piece over all piece lengths is
one vectorised maximum, whose argument is the backpointer.

- Unigram models: a path's score is the sum of its pieces' scores.
- BPE models: their scores are ranks of merges, and a sum of ranks means nothing. What
  the library returns is the one path whose neighbouring pieces stay apart: merging the
  text of two neighbours again gives these two pieces. So a step from a piece to the next
  is worth 0 if they stay apart, else minus infinity, and the best path is the library's.
  Whether two pieces stay apart is read from the trees of their merges (``apart``).

Results equal those of the ``sentencepiece`` library for models whose normaliser is
``identity``. The job is one map over the scan; a worker keeps a bounded cache of words.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.tokenizers import default_path
from tidewell.session import prepare

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the file format
UNIGRAM, BPE = 1, 2
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LONG = 192  # longer words of BPE models are merged one at a time, by a heap
OVER = -2  # stands after the first piece of a path
NEVER = 1 << 40  # later than any merge
LEADING = np.uint64(44)  # all but the leading 20 bits of a hash
CACHE = 400_000
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

codecs.register_error("tidewell_each", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: varints and fixed or delimited bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = b[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, b[i : i + n]
            i += n


def word_matrix(words: list[str]) -> np.ndarray:
    """Code points of words of equal length (n x L, uint64)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes (n x L+1) modulo 2^64."""
    h = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for j in range(points.shape[1]):
        x = points[:, j] + np.uint64(1)
        x ^= x << np.uint64(21)
        h[:, j + 1] = h[:, j] * BASE + x * np.uint64(0xD6E8FEB86659FD93)
    return h


@functools.cache
def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE))), dtype=np.uint64)


class Model:
    """A model file and its tables."""

    def __init__(self, data: bytes):
        pieces, self.kind, norm, self.prefix, squeeze = [], UNIGRAM, "identity", True, True
        for field, value in _fields(data):
            if field == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                f = dict(_fields(value))
                norm, self.prefix, squeeze = f.get(1, b"").decode(), bool(f.get(3, 1)), bool(f.get(4, 1))
        if norm != "identity" or squeeze or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with the identity normaliser that keep white space are read")
        if any(t == USER for _, _, t in pieces):
            raise ValueError("models with user-defined pieces are not read")
        self.pieces = pieces
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        usable = [i for i, p in enumerate(pieces) if p[2] == NORMAL]
        self.by_text = {pieces[i][0]: i for i in usable}
        self.longest = max(len(pieces[i][0]) for i in usable)
        # no piece goes on into the next run of spaces, so units can be encoded apart
        self.split = all(SPACE not in pieces[i][0].lstrip(SPACE) for i in usable)
        hashes = np.array([prefix_hashes(word_matrix([pieces[i][0]]))[0, -1] for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(usable, np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        leading = (self.keys >> LEADING).astype(np.int64)
        count = np.bincount(leading, minlength=1 << 20)
        self.leading, self.first, self.most = count > 0, (np.cumsum(count) - count).astype(np.int32), int(count.max())
        self.key_scores = np.array([pieces[i][1] for i in self.key_ids], np.float32)
        self.floor = np.float32(self.key_scores.min() - 10)
        self.raw = [bytes([int(p[0][3:5], 16)]) if p[2] == BYTE else b"" if p[2] == CONTROL else b" \xe2\x81\x87 " if p[2] == UNKNOWN else p[0].encode() for p in pieces]
        self.cache: dict[str, bytes] = {}
        if self.kind == BPE:
            self.grow_trees(hashes, usable)

    def grow_trees(self, hashes: np.ndarray, usable: list[int]) -> None:
        """For each piece its rank among merges (-1: a symbol, never merged) and the two
        pieces whose merge it is, shorter pieces first."""
        texts = [self.pieces[i][0] for i in usable]
        own, lengths, scores = np.array(usable), np.array([len(t) for t in texts]), np.array([self.pieces[i][1] for i in usable])
        size = len(self.pieces)
        self.hash_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.hash_of[own], self.length_of[own] = hashes, lengths
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        merged = own[lengths > 1]
        self.rank[merged[np.argsort(-scores[lengths > 1], kind="stable")]] = np.arange(len(merged))
        if not {c for t in texts for c in t} <= self.by_text.keys():
            raise ValueError("a piece has a character that is no piece")
        for length in range(2, self.longest + 1):
            ids = own[lengths == length]
            if not len(ids):
                continue
            h, power = prefix_hashes(word_matrix([self.pieces[i][0] for i in ids])), powers(length)
            for k in range(1, length):
                a, b = self.ids_of(h[:, k]), self.ids_of(h[:, length] - h[:, k] * power[length - k])
                row = np.flatnonzero((a >= 0) & (b >= 0))
                row = row[(self.rank[a[row]] < self.rank[ids[row]]) & (self.rank[b[row]] < self.rank[ids[row]])]
                row = row[self.apart(a[row], b[row], self.rank[ids[row]])]
                self.left[ids[row]], self.right[ids[row]] = a[row], b[row]
            if (self.left[ids] < 0).any():
                raise ValueError("a piece is no merge of pieces of lower ranks")

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether pieces a and b, one after the other, stay apart in the merging of their
        joint text before the merge of rank ``until``.

        Backwards in time, the symbols at the border are a and b, then the part of one of
        them that was there before its last merge. A merge across the border happens if
        its rank is lower than that of the merge which ended this pair of symbols (or
        equal, if that one lies to the right: of equal merges the left one is first).
        """
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        x, y, until = a[live].astype(np.int64), b[live].astype(np.int64), np.broadcast_to(until, len(a))[live]
        power = powers(self.longest)
        while len(live):
            where, at = self.probe(self.hash_of[x] * power[self.length_of[y]] + self.hash_of[y])
            across = np.zeros(len(live), bool)
            across[where] = self.rank[self.key_ids[at]] < until[where]
            ok[live[across]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            on = ~across & ((rank_x >= 0) | (rank_y >= 0))
            live, x, y, rank_x, rank_y = live[on], x[on], y[on], rank_x[on], rank_y[on]
            older = rank_x > rank_y
            until = np.where(older, rank_x, rank_y + 1)
            x, y = np.where(older, self.right[x], x), np.where(older, y, self.left[y])
        return ok

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes of pieces are in an array of substring hashes (numbers in its
        flat form), and the numbers of their keys. Most substrings are no piece; a table of
        a hash's leading bits passes most of these over, and tells where among the sorted
        keys the search for the others begins: the keys of equal leading bits are few."""
        flat = hashes.ravel()
        leading = (flat >> LEADING).astype(np.int64)
        near = np.flatnonzero(self.leading[leading])
        own, at = flat[near], self.first[leading[near]]
        found = self.keys[at] == own
        for _ in range(self.most - 1):
            missed = np.flatnonzero(~found)
            at[missed] = np.minimum(at[missed] + 1, len(self.keys) - 1)
            found[missed] = self.keys[at[missed]] == own[missed]
        return near[found], at[found]

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 for those of no piece."""
        ids = np.full(hashes.size, -1, np.int32)
        where, at = self.probe(hashes)
        ids[where] = self.key_ids[at]
        return ids.reshape(hashes.shape)

    def spell(self, text: str) -> list[int]:
        """Ids of a symbol that is no piece: its bytes, or unknown."""
        return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]

    # -- words ---------------------------------------------------------------------

    def merge_long(self, word: str) -> list[int]:
        """BPE over one long word with a heap of pairs."""
        symbols: list[str | None] = list(word)
        left, right = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := self.by_text.get(both := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-self.pieces[k][1], i, j, both))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [y for s in symbols if s is not None for y in ([self.by_text[s]] if s in self.by_text else self.spell(s))]

    def viterbi_group(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length; of equal scores the longest last piece wins."""
        points = word_matrix(words)
        h, n, length = prefix_hashes(points), len(words), points.shape[1]
        power = powers(length)
        best = np.full((n, length + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        r = np.arange(n)
        for end in range(1, length + 1):
            begins = np.arange(max(0, end - self.longest), end)
            where, key = self.probe(h[:, end][:, None] - h[:, begins] * power[end - begins])
            row, at = np.divmod(where, len(begins))
            ids = self.key_ids[key]
            if self.kind == BPE:  # every prefix has one best path, of worth 0
                worth = np.zeros(len(ids), bool)
                inner = begins[at] > 0
                worth[~inner] = True
                worth[inner] = self.apart(piece[row[inner], begins[at[inner]]], ids[inner])
                total = np.zeros((n, len(begins)), np.int8)  # 0: not so, or a symbol by itself
                total[row, at] = worth
                total[:, -1] |= ~total.any(axis=1)
            else:
                score = np.full((n, len(begins)), -np.inf, np.float32)
                score[:, -1] = self.floor
                score[row, at] = self.key_scores[key]
                total = best[:, begins] + score
                best[:, end] = total.max(axis=1)
            top = total.argmax(axis=1)
            back[:, end] = begins[top]
            mine = at == top[row]
            piece[row[mine], end] = ids[mine]
        return self.follow(words, back, piece)

    def follow(self, words: list[str], back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each word along its backpointers, all words at once."""
        r, at, steps = np.arange(len(words)), np.full(len(words), back.shape[1] - 1), []
        while at.any():
            steps.append(np.where(at > 0, piece[r, at], OVER))
            at = back[r, at]
        ids = np.stack(steps[::-1], axis=1)
        there = ids != OVER
        raw, ends = ids[there].astype("<i4").tobytes(), np.concatenate(([0], 4 * np.cumsum(there.sum(axis=1)))).tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for k in np.flatnonzero((ids == -1).any(axis=1)).tolist():  # symbols that are no piece
            own, j = [], back.shape[1] - 1
            while j:
                own.append([int(piece[k, j])] if piece[k, j] >= 0 else self.spell(words[k][back[k, j] : j])[::-1])
                j = int(back[k, j])
            flat = [y for x in own for y in x][::-1]
            if not self.bytes and self.kind == UNIGRAM:  # the library joins neighbouring unknown symbols into one
                flat = [x for i, x in enumerate(flat) if x != self.unknown or not i or flat[i - 1] != x]
            out[k] = np.array(flat, "<i4").tobytes()
        return out

    # -- texts ---------------------------------------------------------------------

    def learn(self, words: set[str]) -> None:
        """Encode words into the cache."""
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(len(w), []).append(w)
        for length, own in groups.items():
            if self.kind == BPE and (length > LONG):
                for w in own:
                    self.cache[w] = np.array(self.merge_long(w), np.uint32).tobytes()
                continue
            size = max(1, 2_000_000 // (length * 8))
            for at in range(0, len(own), size):
                part = own[at : at + size]
                self.cache.update(zip(part, self.viterbi_group(part), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of whole texts; a null or empty text has none."""
        units = []
        for t in texts:
            t = (SPACE if self.prefix and t else "") + (t or "").replace(" ", SPACE)
            units.append(UNITS.findall(t) if self.split else [t] if t else [])
        need = set().union(*units) if units else set()
        missing = need - self.cache.keys()
        if len(self.cache) + len(missing) > CACHE:
            self.cache.clear()
            missing = need
        self.learn(missing)
        known = self.cache
        return [np.frombuffer(b"".join([known[u] for u in own]), np.uint32) for own in units]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined (each invalid byte becomes U+FFFD), the sign for
        a space turned back, and the space put before the text dropped."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "tidewell_each").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _encode(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in _slices(batches):
        texts = batch.column(1).to_pylist()
        ids = model.encode_batch(texts)
        n = pa.array([len(x) for x in ids], pa.int64())
        if digest:
            back = [model.decode(x) for x in ids]
            same = pa.array([a == (b or "") for a, b in zip(back, texts, strict=True)])
            crc = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
            decoded = pa.array([zlib.crc32(x.encode()) for x in back], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, crc, decoded, same], names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"])
        else:
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat), n], names=["doc_id", "ids", "n_tokens"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, digest: bool = False) -> DataFrame:
    """Encode whole texts: doc_id, ids, n_tokens; with ``digest`` doc_id, n_tokens,
    ids_crc32 (little-endian 32-bit ids), decoded_crc32 and round_trip (whether the decoded
    text equals the text; false where the text has U+2581, the model's sign for a space,
    which decodes to a space).

    A null or empty text has no ids and decodes to an empty one. Repeated rows and null ids are kept as they are;
    other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean" if digest else "doc_id long, ids array<int>, n_tokens long"
    run = partial(_encode, path=model_path or default_path("piece_bpe_32k.model"), digest=digest)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in batches:
        texts = [model.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """Texts of id arrays: doc_id, text. Null or empty ids give an empty text."""
    prepare(encoded.sparkSession)
    return encoded.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids").mapInArrow(partial(_decode, path=model_path or default_path("piece_bpe_32k.model")), "doc_id long, text string")
