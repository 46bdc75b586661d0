import random

import numpy as np
import pytest
import sentencepiece as spm
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import hard_rows, prose
from tidewell.llm import sentencepiece as S

PATH = S.default_path("piece_bpe_32k.model")


def as_unigram(data: bytes) -> bytes:
    """The same file with the model type unigram, so that the library runs Viterbi."""
    out, i = bytearray(), 0

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, at

    while i < len(data):
        tag, at = varint(i)
        n, at = varint(at)
        body = data[at : at + n]
        if tag >> 3 == 2:
            body = body.replace(b"\x18\x02", b"\x18\x01", 1)
        out += data[i : at] + body
        i = at + n
    return bytes(out)


TEXTS = [t for _, t, _ in hard_rows()] + [prose(3, 500), "x" * 700, "  a  b  ", "▁▁ a", "ﬁ Ⅷ\t\n\n", "a\x00b", "日本" * 300]


@pytest.mark.parametrize("unigram", [False, True])
def test_equals_the_library(unigram):
    data = open(PATH, "rb").read()
    data = as_unigram(data) if unigram else data
    ours, theirs = S.Model(data), spm.SentencePieceProcessor(model_proto=data)
    assert ours.kind == (S.UNIGRAM if unigram else S.BPE)
    for text, ids in zip(TEXTS, ours.encode_batch(TEXTS), strict=True):
        if unigram and text:  # against the best path of the library's lattice; equal scores may part elsewhere
            total = lambda own: sum(ours.pieces[i][1] for i in own)
            assert total(ids.tolist()) >= total(theirs.nbest_encode_as_ids(text, 1)[0])
        else:
            assert ids.tolist() == theirs.encode(text or ""), text
        assert ours.decode(ids) == theirs.decode(ids.tolist())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    theirs = spm.SentencePieceProcessor(model_file=PATH)
    assert S.load(PATH).encode_batch([text])[0].tolist() == theirs.encode(text)


def test_invalid_bytes_decode_like_the_library():
    theirs, ours = spm.SentencePieceProcessor(model_file=PATH), S.load(PATH)
    rng = np.random.default_rng(0)
    for _ in range(50):
        ids = rng.integers(3, 32000, 20)
        ids[:6] = rng.integers(3, 259, 6)
        assert ours.decode(ids) == theirs.decode(ids.tolist())


def test_round_trip(spark, hard):
    got = {r.doc_id: r for r in S.encode(hard, digest=True).collect()}
    assert S.encode(hard).count() == hard.count()
    assert got[5].n_tokens == got[6].n_tokens == 0
    assert {i for i, r in got.items() if not r.round_trip} == {20}  # the text with U+2581
    texts = {(r.doc_id, r.text) for r in S.decode(S.encode(hard)).collect()}
    assert texts == {(r.doc_id, (r.text or "").replace("▁", " ")) for r in hard.collect()}
    assert S.encode(hard.limit(0)).count() == 0 and S.encode(hard.limit(0), digest=True).count() == 0


def test_viterbi_finds_the_best_of_all_paths():
    """Brute force over all segmentations of short words, scores apart from ties."""
    ours = S.Model(as_unigram(open(PATH, "rb").read()))
    score = lambda p: ours.pieces[ours.by_text[p]][1] if p in ours.by_text else ours.floor if len(p) == 1 else None

    def best(w):
        if not w:
            return 0.0
        return max(score(w[:k]) + best(w[k:]) for k in range(1, len(w) + 1) if score(w[:k]) is not None)

    for w in ("▁the", "▁theing", "▁adipisc", "▁niño", "▁xqzé", "▁▁a"):
        ids = np.frombuffer(ours.viterbi_group([w])[0], np.uint32).tolist()
        known = [i for i in ids if i not in ours.bytes.values()]
        if len(known) == len(ids):
            assert sum(ours.pieces[i][1] for i in ids) == best(w)


def test_words_of_one_letter_pair_and_real_words():
    """Words that merge in many ways, through Viterbi and not the heap, against the library."""
    r = random.Random(8)
    theirs, ours = spm.SentencePieceProcessor(model_file=PATH), S.load(PATH)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for letters in ("ab", "aeinrst", "esti", "0123", "é▁n", "=-.") for _ in range(300)}
    words |= {p for p, _, kind in ours.pieces if kind == S.NORMAL}
    for word in sorted(words):
        text = word.replace(S.SPACE, " ")
        assert ours.encode_batch([text])[0].tolist() == theirs.encode(text), text


def test_long_words_by_heap_equal_viterbi():
    r = random.Random(9)
    ours = S.load(PATH)
    for _ in range(40):
        word = "".join(r.choice("aeinrsté日") for _ in range(r.randrange(1, 120)))
        assert np.frombuffer(ours.viterbi_group([word])[0], np.uint32).tolist() == ours.merge_long(word)
