"""Token ids of whole texts, with each distinct word encoded once per worker.

The tokenizer drops white space and no piece of it crosses white space, so a text's
ids are those of its white-space separated words, one after another. A cache of
word to ids therefore gives exactly the ids of the whole text. Texts that hold the
start of a special token's string go through the tokenizer whole, and so does every text
where the tokenizer's file has other rules than the ones this rests on.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

#: Bytes of the cache of a worker, about (some 250,000 words); later words are encoded anew for each batch.
CACHE_BYTES = 36 << 20
#: Of those for each word, besides its letters and ids: two objects and a place in the table.
_ENTRY_BYTES = 120
#: Words that need no normalising but lower case: Latin letters and one mark at the end.
_PLAIN = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
#: A mark alone at the end of a word, after a letter: always a piece of its own, so the cache needn't hold the word with each mark.
_MARK = re.compile(rb"[.,;:!?](?<=[a-z].)(?!\S)")

#: The rules that make words independent of each other, as the tokenizer's file spells them (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

_ENCODERS: dict[str, WordEncoder] = {}


def by_words(path: str) -> bool:
    """Whether a tokenizer's file has the rules under which a text's ids are those of its words."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model, added = rules["model"], rules["added_tokens"]
    return (
        rules["normalizer"] == _NORMALIZER
        and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        and model["type"] == "BPE"
        and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        and all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in added)
        and not rules.get("truncation")
    )


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Cache(dict):
    """Ids of words, learned when they are asked for: of so many as have room, and of the rest until it is cleared."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        super().__init__()
        self.learn, self.held = learn, 0
        self.rest: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.rest.get(word)
        if ids is None:
            ids = self.learn(word)
            size = _ENTRY_BYTES + len(word) + len(ids)
            if self.held + size <= CACHE_BYTES:
                self[word] = ids
                self.held += size
            else:
                self.rest[word] = ids
        return ids


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words = by_words(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.specials = tuple({t.content[:2].lower().encode() for t in self.whole.get_added_tokens_decoder().values()})
        self.cache = _Cache(self.ids_of)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _piece_ids(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def ids_of(self, word: bytes) -> bytes:
        """The ids of a word without its neighbours."""
        if word.isalpha():  # lower-case letters of ASCII: one piece
            return self._piece_ids(word.decode())
        m = _PLAIN.fullmatch(text := word.decode())
        if m is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = self._piece_ids(m[1].lower())
        return ids + self._piece_ids(m[2]) if m[2] else ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, in UTF-8, as bytes."""
        if not self.words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        out = []
        for text in texts:
            lower = text.lower()
            if any(s in lower for s in self.specials):
                out.append(np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join(map(self.cache.__getitem__, _MARK.sub(rb" \g<0>", lower).split())))
        self.cache.rest.clear()
        return out
