"""Token ids of a public byte-level vocabulary."""

from __future__ import annotations

import base64
import functools

import numpy as np

# The text of the one special token; where it stands in a document the tokenizer file makes it one id.
_SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=4)
def _fast(ranks_file: str, pattern: str):
    import tiktoken
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(ranks_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _exact(tokenizer_file: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file)


def vocabulary() -> tuple[str, str, str]:
    """Tokenizer file, the same vocabulary as ranks, and its splitting pattern; looked up on the executor that runs."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_ids(text: str, files: tuple[str, str, str], special: bool = True) -> np.ndarray:
    """Ids of ``tokenizers.Tokenizer.from_file(files[0]).encode(text, add_special_tokens=False)`` as 32-bit numbers.

    The ranks of the same vocabulary give the same ids several times faster; texts with the special token go
    through the tokenizer file itself.  Without ``special`` that token's name is ordinary text.
    """
    if special and _SPECIAL in text:
        return np.array(_exact(files[0]).encode(text, add_special_tokens=False).ids, np.uint32)
    return _fast(files[1], files[2]).encode_to_numpy(text, disallowed_special=())
