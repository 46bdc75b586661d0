"""Loading of the public tokenizer files inside Python workers, once per process."""

from __future__ import annotations

import base64
import functools
import json
from pathlib import Path

import numpy as np


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _added_tokens(ranks_path: str) -> dict[str, int]:
    named = Path(ranks_path).with_suffix(".json")
    return {t["content"]: t["id"] for t in json.loads(named.read_text(encoding="utf-8"))["added_tokens"]} if named.exists() else {}


@functools.lru_cache(maxsize=4)
def byte_bpe(ranks_path: str):
    """The byte-level BPE of a ``.tiktoken`` ranks file. It has the vocabulary of the
    ``.json`` file of the same name, its added tokens too, and gives the same ids,
    several times faster. Without such a file there are no added tokens."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_added_tokens(ranks_path))


def encode(encoding, text: str | None) -> np.ndarray:
    """Ids of a whole text as uint32, added tokens in it as ordinary text; a null or empty text has none."""
    return encoding.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)


def encode_added(encoding, text: str | None) -> np.ndarray:
    """As ``encode``, but an added token in the text gets its own id, as the tokenizer file gives by default."""
    return encoding.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)


@functools.lru_cache(maxsize=4)
def sentence_end_ids(ranks_path: str) -> np.ndarray:
    """A flag per id: its bytes end in a full stop, ``!``, ``?`` or a line feed."""
    encoding = byte_bpe(ranks_path)
    ends = np.zeros(encoding.n_vocab + 1, bool)
    for i in range(encoding.n_vocab):
        ends[i] = encoding.decode_single_token_bytes(i)[-1:] in (b".", b"!", b"?", b"\n")
    return ends
