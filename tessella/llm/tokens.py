"""Token ids of the byte-level BPE vocabulary of 50,257 ids, from its ranks file.

The ranks give the ids that the vocabulary's tokenizers file gives (tests hold them against each other), about three times
as fast. That file also lists added tokens: where one's string stands in a text, it has the added token's id, and what lies
before and after is encoded apart, as the tokenizers do."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

NAMED = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Longer texts are encoded in parts of about so many characters.
PART = 1 << 19
#: The vocabulary splits before such a space in any case.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


@lru_cache(maxsize=4)
def encoding(path: str = RANKS) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> list[str]:
    """The text in parts that are encoded alike apart and together."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


@lru_cache(maxsize=4)
def added(path: str = NAMED) -> tuple[re.Pattern, dict[str, int]]:
    """The added tokens of the tokenizers file: an expression that finds one, the longest first, and their ids."""
    with open(path, encoding="utf-8") as f:
        found = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return re.compile("|".join(map(re.escape, sorted(found, key=len, reverse=True))) or r"(?!)"), found


def ids(text: str, path: str = RANKS, named: str = NAMED) -> np.ndarray:
    encode, (wanted, known) = encoding(path).encode_ordinary, added(named)
    out, at = [], 0
    for m in wanted.finditer(text):
        out += [np.array(encode(x), dtype="<u4") for x in parts(text[at : m.start()])]
        out.append(np.array([known[m[0]]], dtype="<u4"))
        at = m.end()
    return np.concatenate([*out, *(np.array(encode(x), dtype="<u4") for x in parts(text[at:]))])
