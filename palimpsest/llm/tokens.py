"""Token ids of whole texts by a public tokenizer, with a cache of words.

Most texts consist of characters for which the tokenizer's normalisation acts on each character by itself, and
no token of its pattern spans white space. Such a text is lower-cased and cut at white space, and the ids
of each piece are looked up; a piece not met yet is cut by the pattern, and words not met yet go through the
tokenizer's own model. Every other text goes through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array

VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Bytes of pieces, and of words, that a worker keeps; at the limit it starts anew. A bound of memory only: results do not depend on it.
CACHE_BYTES = 80 << 20
#: What an entry costs besides its text and ids.
ENTRY = 200
#: Characters below U+0300 are normalised one by one; left out are control characters, other spaces,
#: a letter that lower-cases to two, and the opening of special tokens' names.
_UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-˿]|<\\|")
#: The vocabulary's pattern for such lower-case text: fixed values of the tokenizer's file.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next beyond 255."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """A dictionary that computes what it lacks and starts anew when it holds CACHE_BYTES."""

    held = 0

    def __missing__(self, text: str) -> bytes:
        if self.held > CACHE_BYTES:
            self.clear()
        found = self[text] = self.made(text)
        self.held += ENTRY + len(text) + len(found)
        return found

    def clear(self) -> None:
        super().clear()
        self.held = 0


class _Words(_Cache):
    """word -> ids, by the tokenizer's model."""

    def __init__(self, tokenizer):
        self.model, self.letters = tokenizer.model, _byte_letters()

    def made(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


class _Pieces(_Cache):
    """piece without white space -> ids."""

    def __init__(self, tokenizer):
        import regex

        self.words, self.cut = _Words(tokenizer), regex.compile(_PATTERN).findall

    def made(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.cut(piece)))


class Ids:
    """``of(text)``: little-endian 32-bit ids of a text, exactly the tokenizer's, without the end id."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        # the rules above hold for this vocabulary's normaliser and pattern
        self.pieces = _Pieces(self.tokenizer) if os.path.basename(path) == VOCABULARY else None

    def of(self, text: str) -> bytes:
        if self.pieces is None or _UNSAFE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))


_END = array("I", [END_ID]).tobytes()
_workers: dict[str | None, Ids] = {}


def forget() -> None:
    """Empty the caches; tasks that do not tokenise call it, so that a reused worker holds none for them."""
    for found in _workers.values():
        if found.pieces is not None:
            found.pieces.clear()
            found.pieces.words.clear()


def document_ids(text: str | None, path: str | None = None) -> bytes:
    """Ids of a document and ``END_ID``, as little-endian uint32 bytes; the tokenizer is loaded once in each worker."""
    if path not in _workers:
        _workers[path] = Ids(path)
    return _workers[path].of(text or "") + _END
