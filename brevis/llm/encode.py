"""Token ids of whole texts, by the tokenizers library, with a memo of words."""

from __future__ import annotations

import json
import re

import numpy as np

#: Tokenizers of a worker process, by path and width.
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}

_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_BLANK = str.maketrans("\n\t\r", "   ")


# The normalizer and pre-tokenizer under which a text's ids are those of its words.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Encodes texts to packed little-endian ids.

    Under the normalizer and pre-tokenizer BY_WORDS no text is joined across a blank, tab or line end, and nothing is composed
    across one, so the ids of a text are those of its words in turn. Each word is encoded by the library once and kept in
    one of two generations of at most `keep` words, so memory stays bounded on any input. A vocabulary with others, or with
    added tokens that hold white space or are normalized, gets whole texts, as the library takes them.
    """

    def __init__(self, path: str, width: int, keep: int = 250_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) for t in config.get("added_tokens") or [])
        self.by_words = plain and all(config.get(k) == v for k, v in BY_WORDS.items())
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype(f"<u{width}")
        if self.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"ids of {path} don't fit in {width} bytes")
        self.keep, self.new, self.old = keep, {"": b""}, {}
        self.bytes = byte_chars()

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token of letters, already in lower case."""
        if (found := self.old.get(piece)) is None:
            key = piece if piece.isascii() else "".join(self.bytes[b] for b in piece.encode())
            found = self.pack([t.id for t in self.model.tokenize(key)])
        return found

    def _learn(self, word: str) -> bytes:
        if (found := self.old.get(word)) is None:
            if m := _PLAIN.fullmatch(word):
                stem = m[1].lower()
                if (found := self.new.get(stem)) is None:
                    found = self.new[stem] = self._piece(stem)
                if m[2]:
                    found += self.ends[m[2]]
            else:
                found = self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self.new[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; none for null."""
        if not text:
            return b""
        if not self.by_words:
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.new) > self.keep:
            self.old, self.new = self.new, {"": b""}
        words = text.translate(_BLANK).split(" ") if len(text) < 200 else text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.new
        for word in set(words).difference(known):
            self._learn(word)
        return b"".join(map(known.__getitem__, words))

    @property
    def ends(self) -> dict[str, bytes]:
        if not hasattr(self, "_ends"):
            self._ends = {x: self.pack(self.tokenizer.encode(x, add_special_tokens=False).ids) for x in ".,"}
        return self._ends


def encoder(path: str, width: int = 4) -> WordEncoder:
    """The worker's encoder for a vocabulary file; made once in each process."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = WordEncoder(path, width)
    return _ENCODERS[path, width]
