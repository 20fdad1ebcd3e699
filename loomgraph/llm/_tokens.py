"""Token ids of a public tokenizer file, word by word with a bounded cache.

The tokenizer's rules never join characters over white space, so a text's ids are those of its words one after the
other, and most words repeat. Words of Latin letters (up to U+017F, where no normalisation form applies) are split
here by the file's own pattern and only its merge model is asked; the whole tokenizer is asked for all others.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Words whose ids a task keeps (some 200 bytes each); rarer ones that come later are looked up each time.
CACHE_WORDS = 200_000
#: The word pattern that the fast path knows; a file with another one takes the general path.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _NUMBER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_FAST = re.compile("[\t-\r\x20-\x7e\xa1-įı-ž]*")
#: The same pattern; letters and numbers come first as the others can't start with one.
_WORD = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTER}{_NUMBER}]+")
#: Only ASCII white space parts words on the general path; str.split() would take more.


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [s["type"] for s in (made.get("normalizer") or {}).get("normalizers", [])]
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and _PATTERN in json.dumps(made["pre_tokenizer"]).replace("\\\\", "\\")
        self.special = [t["content"] for t in made["added_tokens"]]
        self.model = self.tokenizer.model
        self.known = _Known(self._model_ids)
        self.words = _Known(self._word_ids)
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.high = str.maketrans(self.letters)

    def _model_ids(self, word: str) -> bytes:
        word = word if word.isascii() else word.encode().decode("latin-1").translate(self.high)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _word_ids(self, word: str) -> bytes:
        """Of what stands between ASCII white space."""
        if self.fast and _FAST.fullmatch(word) and not any(x in word for x in self.special):
            return b"".join(map(self.known.__getitem__, _WORD.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.words.__getitem__, _spaced(text).split(" ")))


def _spaced(text: str) -> str:
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text


class _Known(dict):
    """The ids of words; it takes no more than CACHE_WORDS."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        ids = self.ask(word)
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


_loaded: dict[str, Encoder] = {}


def encode(texts: list[str], path: str) -> list[bytes]:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return list(map(_loaded[path].encode, texts))


def forget() -> None:
    """Ends a task: its words go, as the worker lives on under other work; the tokenizers stay."""
    for encoder in _loaded.values():
        encoder.known.clear()
        encoder.words.clear()
