"""Token ids of whole texts by a public tokenizer, with a bounded cache of words."""

from __future__ import annotations

import array
import re

ID_BYTES = 4
#: Characters in which a word's parts (runs of letters, single digits, other runs) can be told
#: apart before it is put in lower case; without marks that make contractions or special tokens.
PLAIN = re.compile(r"(?:(?!['|])[\x21-\x7e\u00c0-\u012f\u0131-\u017e])+")
PARTS = re.compile(r"[^\W\d_]+|[0-9]|[\W_]+")
_encoders: dict[str, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in prints else next(others)) for b in range(256)}


class WordEncoder(dict):
    """Ids (little-endian uint32) of a text, one run of non-white bytes at a time.

    The word BPE vocabulary drops white space and joins nothing across it, so the ids of a
    text are those of its runs one after the other.  A plain run's parts go to the merge table
    directly, in lower case; any other run goes through the whole tokenizer.  ``cache_words``
    bounds the runs kept, and the parts; once they are reached, others are encoded anew.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _part(self, part: str) -> bytes:
        out = self.parts.get(part)
        if out is None:
            text = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            out = array.array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(self.parts) < self.cache_words:
                self.parts[part] = out
        return out

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text):
            out = b"".join([self._part(p) for p in PARTS.findall(text.lower())])
        else:
            out = array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < self.cache_words:
            self[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.encode().split()))


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker for the vocabulary file at ``path``."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
