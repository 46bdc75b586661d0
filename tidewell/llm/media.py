"""Audio features of payload bytes stored as 8-bit PCM.

A payload becomes a mono WAV file of unsigned 8-bit samples, one sample a byte, so
nothing is lost. The stored bytes are parsed again; what they hold is resampled by the
rational rate ``UP / DOWN``, with one phase of a polyphase filter for each of ``UP`` places
between input samples, cut into overlapping frames, turned into log-mel energies, and
segmented by hysteresis on frame energy: a segment opens above the upper threshold and
closes below the lower one, thresholds lying between the clip's quiet and loud frames.
Energies are means over a fixed number of equal time spans, so that every clip has a
tensor of one shape; the tensors of a batch are one Arrow column of fixed-shape tensors.
The job is one map over the scan.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.session import prepare

RATE, UP, DOWN, TAPS = 8000, 3, 4, 32
FRAME, HOP, FFT, MELS, SPANS = 200, 80, 256, 16, 8
BLOCK = 1 << 20  # samples resampled at once


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples (an even number of them)."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples, by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@functools.cache
def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc filter, split into ``up`` phases (rows)."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    return (h / h.sum() * up).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase rational resampling: output k is phase ``k*down % up`` applied at input
    ``k*down // up``. Only outputs that are kept get computed; long inputs go by blocks."""
    phases = low_pass(up, down, taps)
    total = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(taps - 1, np.float32), x, np.zeros(taps, np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(total, np.float32)
    for first in range(0, total, BLOCK):
        k = np.arange(first, min(first + BLOCK, total)) * down
        phase = k % up
        for p in np.unique(phase):
            mine = np.flatnonzero(phase == p)
            at = k[mine] // up
            step = at[1] - at[0] if len(at) > 1 else 1
            out[first + mine] = windows[at[0] : at[-1] + 1 : step] @ phases[p][::-1]
    return out


@functools.cache
def mel_bank(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale (fft/2+1 x mels)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mels(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x MELS) and log energy of each frame, in blocks of frames."""
    if len(x) < FRAME:
        x = np.concatenate((x, np.zeros(FRAME - len(x), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate)
    mels, energy = [], []
    for at in range(0, len(frames), 4096):
        part = frames[at : at + 4096]
        power = np.abs(np.fft.rfft(part * window, FFT, axis=1)).astype(np.float32) ** 2
        mels.append(np.log(power @ bank + 1e-6))
        energy.append(np.log((part * part).mean(axis=1) + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of frames: open above the upper threshold, close below the lower."""
    quiet, loud = np.quantile(energy, [0.1, 0.9])
    upper, lower = quiet + 0.6 * (loud - quiet), quiet + 0.3 * (loud - quiet)
    mark = np.where(energy > upper, 1, np.where(energy < lower, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = np.concatenate(([False], (last >= 0) & (mark[last] == 1), [False]))
    change = np.flatnonzero(active[1:] != active[:-1])
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def features(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A SPANS x MELS tensor of mean log-mel energies, and segments in milliseconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y, new_rate = resample(x), rate * UP // DOWN
    mels, energy = log_mels(y, new_rate)
    edges = np.linspace(0, len(mels), SPANS + 1)
    tensor = np.stack([mels[int(a) : max(int(a) + 1, int(np.ceil(b)))].mean(axis=0, dtype=np.float64) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    ms = lambda k: k * HOP * 1000 // new_rate
    return tensor.astype(np.float32), [(ms(a), ms(b)) for a, b in segments(energy)]


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (SPANS, MELS), dim_names=("span", "mel"))


def tensor_column(tensors: list[np.ndarray]) -> pa.ExtensionArray:
    """Tensors of one shape as an Arrow column of fixed-shape tensors."""
    flat = np.concatenate([t.ravel() for t in tensors]) if tensors else np.empty(0, np.float32)
    return pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), SPANS * MELS))


SCHEMA = "doc_id long, media binary, rate int, tensor array<float>, tensor_shape array<int>, segments array<struct<start_ms:long,end_ms:long>>, n_bytes long"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCKS = "n long, arrow binary"
SEGMENTS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
ROWS = 256  # rows worked on at once


def _clips(batch: pa.RecordBatch) -> pa.Table:
    """doc_id, media, rate, samples (read back), tensor (fixed shape), segments and n_bytes
    of a batch of doc_id and text."""
    rows = []
    for text in batch.column(1):
        raw = text.as_py()
        media = to_wav(payload(raw))
        rate, samples = from_wav(media)
        tensor, found = features(samples, rate)
        rows.append((media, rate, samples, tensor, [{"start_ms": a, "end_ms": b} for a, b in found], len((raw or "").encode())))
    media, rate, samples, tensors, found, n = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.table(
        {"doc_id": batch.column(0), "media": pa.array(media, pa.binary()), "rate": pa.array(rate, pa.int32()), "samples": pa.array(samples, pa.binary()), "tensor": tensor_column(list(tensors)), "segments": pa.array(found, SEGMENTS), "n_bytes": pa.array(n, pa.int64())}
    )


def _digest(clips: pa.Table) -> pa.RecordBatch:
    rows = []
    tensors = clips["tensor"].combine_chunks().to_numpy_ndarray()
    for media, samples, tensor, found, n in zip(clips["media"].to_pylist(), clips["samples"].to_pylist(), tensors, clips["segments"].to_pylist(), clips["n_bytes"].to_pylist(), strict=True):
        told = hashlib.sha256(np.round(tensor * 100).astype("<i4").tobytes()).hexdigest()[:16]
        mean = ",".join(f"{x:.2f}" for x in tensor.mean(axis=0, dtype=np.float64) + 0.0)
        feature = f"{mean}|{told}|{len(found)}:{sum(x['end_ms'] - x['start_ms'] for x in found)}ms"
        rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([clips["doc_id"].combine_chunks(), *arrays], names=[x.split()[0] for x in DIGEST.split(", ")])


def _encode(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            clips = _clips(batch.slice(at, ROWS))
            if digest:
                yield _digest(clips)
            else:
                tensors = clips["tensor"].combine_chunks().storage.cast(pa.list_(pa.float32()))
                shape = pa.array([[SPANS, MELS]] * len(clips), pa.list_(pa.int32()))
                arrays = [clips["doc_id"], clips["media"], clips["rate"], tensors, shape, clips["segments"], clips["n_bytes"]]
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays], names=["doc_id", "media", "rate", "tensor", "tensor_shape", "segments", "n_bytes"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            clips = _clips(batch.slice(at, ROWS)).select(["doc_id", "tensor", "segments"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, clips.schema) as out:
                out.write_table(clips)
            yield pa.RecordBatch.from_arrays([pa.array([len(clips)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n", "arrow"])


def tensor_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n, arrow: Arrow streams of up to ``ROWS`` clips each, with the columns doc_id, tensor
    (of the fixed-shape tensor type) and segments. They may be written by any sink; ``read_block`` opens
    one. Rows are treated as ``audio`` does; an empty table gives no blocks."""
    prepare(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(_blocks, BLOCKS)


def read_block(arrow: bytes) -> pa.Table:
    return pa.ipc.open_stream(arrow).read_all()


def audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Store whole texts as 8-bit audio and describe it.

    ``digest=False``: doc_id, media (WAV), rate, tensor (SPANS x MELS floats in row
    order), tensor_shape, segments (spans of time), n_bytes; ``tensor_blocks`` gives
    Arrow streams with the tensors as a column of fixed shape. ``digest=True``: sizes and checksums of payload and media as read back, and
    the features as a string.

    A null or empty text is 64 bytes 0, whose frames all have one energy: no segment.
    Equal texts have equal values; repeated rows and null ids are kept as they are; other
    columns are not read; an empty table gives no rows. Values are rounded so that
    the string does not hang on the order of additions.
    """
    prepare(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(partial(_encode, digest=digest), DIGEST if digest else SCHEMA)
