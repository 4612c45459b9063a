"""Byte-level BPE in worker processes: ids as the `tokenizers` library gives them, at tiktoken's speed."""

from __future__ import annotations

import functools
import json
import os

import numpy as np

SPECIAL = "<|endoftext|>"
#: Splitting pattern of the 50k byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(2)
def _loaded(path: str):
    """(fast encoder, byte length of each id, function that gives the reference library's tokenizer)."""
    import tiktoken

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    letters = _byte_letters()
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    vocab = {t: i for t, i in file["model"]["vocab"].items() if t not in added}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
    lengths = np.zeros(1 + max([*vocab.values(), *added.values()]), np.int64)
    for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
        lengths[i] = len(token)

    @functools.lru_cache(1)
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths, slow


def encode(text: str, path: str) -> np.ndarray:
    """Ids (uint32) of the text. One that holds the special token's own string goes to the library itself."""
    fast, _, slow = _loaded(path)
    if SPECIAL in text:
        return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), np.uint32)


def byte_lengths(path: str) -> np.ndarray:
    """Bytes of text that each id stands for."""
    return _loaded(path)[1]


