"""Token ids of whole texts in the byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import re
from array import array

VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: The vocabulary's pattern without its look-ahead, which matters only where white space follows white space.
_PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_RUN = re.compile(r"\s\s")


class Encoder:
    """ids_bytes(text): the ids of `text` as little-endian unsigned 32-bit numbers.

    They equal those of the `tokenizers` file of the same vocabulary with
    add_special_tokens=False: no token is put around a text, but the strings of
    the file's added tokens have these tokens' ids wherever a text holds them,
    and the stretches between them are encoded by themselves. Stretches
    without two white-space characters in a row need no look-ahead and go
    through an equivalent pattern that is half as slow.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(TOKENIZER), "rb") as file:
            added = json.load(file)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that match by more than their string")
        self._added = {t["content"]: t["id"] for t in added}
        longest = sorted(self._added, key=len, reverse=True)
        self._marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._names = {i: mark.encode() for mark, i in self._added.items()}
        plain, self._core = (
            # The list of ids as it comes, without the wrapper's second pass over the text.
            tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe
            for p in (_PLAIN, public_tokenizers.PATTERN)
        )
        self._plain, self._full = plain.encode_ordinary, self._core.encode_ordinary

    @property
    def marks(self) -> list[str]:
        """The strings of the added tokens."""
        return list(self._added)

    def token(self, i: int) -> bytes:
        """The bytes that a token stands for."""
        return self._names.get(i) or self._core.decode_single_token_bytes(i)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether token `b` right after token `a` within one pre-token is how the vocabulary writes their bytes."""
        return self._core.encode_single_piece(self.token(a) + self.token(b)) == [a, b]

    def ids(self, text: str) -> list[int]:
        if any(mark in text for mark in self._added):
            out: list[int] = []
            for i, part in enumerate(self._marks.split(text)):
                out += [self._added[part]] if i % 2 else self._ordinary(part)
            return out
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        return (self._full if _RUN.search(text) else self._plain)(text)

    def ids_bytes(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
