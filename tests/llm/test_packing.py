import random
import zlib
from itertools import combinations

import numpy as np
from tokenizers import Tokenizer

from tests.llm.conftest import hard_rows
from tidewell.llm import packing as P
from tidewell.llm import token_counts
from tidewell.llm.tokenizers import byte_bpe, default_path, encode, encode_added


def test_ids_equal_the_tokenizer_file():
    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = byte_bpe(default_path("byte_bpe_50k.tiktoken"))
    r = random.Random(0)
    texts = [x or "" for _, x, _ in hard_rows()] + ["<|endoftext|> a", "a b 　 c\x85d", "x" * 5000]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), r.randrange(0x10000, 0x1F000)])) for _ in range(200)) for _ in range(40)]
    for x in texts:
        assert encode(own, x).tolist() == t.encode(x, add_special_tokens=False).ids


def brute(at, cost, window):
    best = None
    inner = range(len(at) - 1)
    for n in range(len(at)):
        for chosen in combinations(inner, n):
            ends = [at[i] for i in chosen] + [at[-1]]
            sizes = np.diff([0, *ends])
            if sizes.max() <= window:
                total = sum(window - sizes) + sum(cost[i] for i in chosen) + cost[-1]
                best = total if best is None else min(best, total)
    return best


def test_cuts_cost_least():
    r = random.Random(1)
    for _ in range(60):
        at = np.cumsum([r.randint(1, 8) for _ in range(r.randint(1, 10))])
        cost = np.array([r.choice([0.0, 1.0, 4.0]) for _ in at])
        cuts = P.best_cuts(at, cost, 16)
        sizes = np.diff([0, *cuts])
        total = sum(16 - sizes) + sum(cost[np.searchsorted(at, cuts)])
        assert sizes.max() <= 16 and cuts[-1] == at[-1] and abs(total - brute(at, cost, 16)) < 1e-9


def test_every_id_lies_in_one_piece(spark, hard):
    rows = P.pack(hard, window=64, block_tokens=500).collect()
    own = byte_bpe(default_path("byte_bpe_50k.tiktoken"))
    docs = [(r.doc_id, np.append(encode(own, r.text), np.uint32(0))) for r in hard.collect()]
    assert sum(r.length for r in rows) == sum(len(x) for _, x in docs)
    want = {}
    for i, ids in docs:
        want.setdefault((i, len(ids)), []).append(ids)
    seen = {}
    for r in rows:
        ids = want[(r.doc_id, r.doc_tokens)][0]
        assert zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32
        seen.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for key, pieces in seen.items():
        times = len(want[key])
        assert sorted(x for s, n in pieces for x in range(s, s + n)) == sorted(list(range(key[1])) * times)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own_rows in by_sequence.values():
        own_rows.sort(key=lambda r: r.offset)
        at = 0
        for r in own_rows:
            assert r.offset == at
            at += r.length
        assert at == own_rows[0].sequence_tokens <= 64
    assert P.pack(hard.limit(0)).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [r[0] for r in P.pack(docs).select("sequence_tokens", "sequence_id").distinct().collect()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding < 0.01 * sum(sizes)


def test_added_tokens_get_the_ids_of_the_file(spark):
    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    own = byte_bpe(default_path("byte_bpe_50k.tiktoken"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n x", "don<|endoftext|>'t  <|endoftext", "é<|endoftext|>日本 ", "no such token"]
    for x in texts:
        assert encode_added(own, x).tolist() == t.encode(x, add_special_tokens=False).ids
    assert encode_added(own, "a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    docs = spark.createDataFrame([(i, x, "web", "en") for i, x in enumerate(texts)], "doc_id long, text string, source string, lang string")
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    pieces = P.pack(docs, window=64).collect()
    assert sum(r.length for r in pieces) == sum(len(x) + 1 for x in want)
    for r in pieces:
        ids = np.array([*want[r.doc_id], 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    counted = token_counts.counts(docs, default_path("byte_bpe_50k.tiktoken"), "v1").collect()
    assert {r.doc_id: r.n_tokens for r in counted} == {i: len(x) for i, x in enumerate(want)}
