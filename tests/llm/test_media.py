import hashlib
import zlib

import numpy as np
import pytest

from tidewell.llm import media as A


def test_digest_of_stored_bytes(spark, hard):
    rows = A.audio(hard, digest=True).collect()
    assert len(rows) == hard.count()
    texts = {}
    for r in hard.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in rows:
        found = False
        for t in texts[r.doc_id]:
            raw = (t or "").encode()
            want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            if (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:])):
                assert r.media_bytes == len(want) + 44 and r.media_sha256 == hashlib.sha256(A.to_wav(want)).hexdigest()
                found = True
        assert found
    assert len({r.feature for r in rows if r.doc_id == 2}) == 1
    assert A.audio(hard.limit(0), digest=True).count() == 0 == A.audio(hard.limit(0)).count()


def test_media_and_tensors(spark, hard):
    out = A.audio(hard).toArrow()
    n = A.SPANS * A.MELS
    for row in out.to_pylist():
        rate, samples = A.from_wav(row["media"])
        assert rate == A.RATE and samples[: row["n_bytes"]].rstrip(b"\0") == samples.rstrip(b"\0") and len(row["tensor"]) == n
        assert row["tensor_shape"] == [A.SPANS, A.MELS]


def test_blocks_hold_fixed_shape_tensors(spark, hard, tmp_path):
    path = str(tmp_path / "blocks")
    A.tensor_blocks(hard).write.parquet(path)
    blocks = [A.read_block(bytes(r.arrow)) for r in spark.read.parquet(path).collect()]
    assert all(b.schema.field("tensor").type == A.tensor_type() for b in blocks)
    got = sorted((str(i), t.ravel().tolist()) for b in blocks for i, t in zip(b["doc_id"].to_pylist(), b["tensor"].combine_chunks().to_numpy_ndarray(), strict=True))
    assert got == sorted((str(r.doc_id), list(r.tensor)) for r in A.audio(hard).collect())
    assert A.tensor_blocks(hard.limit(0)).count() == 0


def plain_features(samples):
    """Tensor and segments by the definitions: every output, frame and filter by itself."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    h = A.low_pass(A.UP, A.DOWN, A.TAPS).T.reshape(-1).astype(np.float64)
    y = np.zeros(-(-len(x) * A.UP // A.DOWN))
    for k in range(len(y)):
        for j in range(len(h)):  # the place k * DOWN of the upsampled signal, j places back
            place = k * A.DOWN - j
            if place >= 0 and place % A.UP == 0 and place // A.UP < len(x):
                y[k] += h[j] * x[place // A.UP]
    rate = A.RATE * A.UP // A.DOWN
    y = np.concatenate((y, np.zeros(max(0, A.FRAME - len(y)))))
    mels, energy = [], []
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(20) + (mel(rate / 2) - mel(20)) * i / (A.MELS + 1)) / 2595) - 1) for i in range(A.MELS + 2)]
    for at in range(0, len(y) - A.FRAME + 1, A.HOP):
        frame = y[at : at + A.FRAME]
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(A.FRAME) / (A.FRAME - 1))
        t = np.arange(A.FRAME)
        power = [abs((frame * window * np.exp(-2j * np.pi * b * t / A.FFT)).sum()) ** 2 for b in range(A.FFT // 2 + 1)]
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False):
            weights = [max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for f in (b * rate / A.FFT for b in range(A.FFT // 2 + 1))]
            row.append(np.log(np.dot(power, weights) + 1e-6))
        mels.append(row)
        energy.append(np.log((frame**2).mean() + 1e-9))
    cuts = np.linspace(0, len(mels), A.SPANS + 1)
    tensor = [np.mean(mels[int(a) : max(int(a) + 1, int(np.ceil(b)))], axis=0) for a, b in zip(cuts, cuts[1:], strict=False)]
    quiet, loud = np.quantile(energy, [0.1, 0.9])
    found, start = [], None
    for i, e in enumerate(energy):
        if start is None and e > quiet + 0.6 * (loud - quiet):
            start = i
        elif start is not None and e < quiet + 0.3 * (loud - quiet):
            found, start = [*found, (start, i)], None
    if start is not None:
        found.append((start, len(energy)))
    return np.array(tensor), [(a * A.HOP * 1000 // rate, b * A.HOP * 1000 // rate) for a, b in found]


def test_features_equal_their_definitions():
    from tests.llm.conftest import hard_rows

    for text in [t for _, t, _ in hard_rows() if len(t or "") < 2000]:
        samples = A.payload(text)
        tensor, found = A.features(samples, A.RATE)
        want, spans = plain_features(samples)
        assert np.allclose(tensor, want, atol=2e-3), np.abs(tensor - want).max()
        assert found == spans


@pytest.mark.parametrize(("up", "down"), [(3, 4), (1, 2), (3, 2), (2, 3), (1, 1)])
def test_resampling_equals_upsample_filter_downsample(up, down):
    rng = np.random.default_rng(0)
    x = rng.normal(size=301).astype(np.float32)
    full = np.zeros(len(x) * up)
    full[::up] = x
    h = A.low_pass(up, down, 16).T.reshape(-1)
    want = np.convolve(full, h)[: len(full)][::down]
    assert np.allclose(A.resample(x, up, down, 16), want, atol=1e-4)


def test_a_tone_and_its_segment():
    rate = 4000
    t = np.arange(rate) / rate
    x = np.where((t > 0.3) & (t < 0.7), np.sin(2 * np.pi * 1000 * t), 0).astype(np.float32)
    mels, energy = A.log_mels(x, rate)
    (a, b) = A.segments(energy)[0]
    assert len(A.segments(energy)) == 1 and abs(a * A.HOP / rate - 0.3) < 0.06 and abs(b * A.HOP / rate - 0.7) < 0.06
    assert abs(A.mel_bank(rate)[64].argmax() - mels[len(mels) // 2].argmax()) <= 1
    assert A.segments(np.zeros(10)) == []
