"""Token ids of the public tokenizers, word by word with a bounded cache."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from unicodedata import is_normalized

#: What str.split() splits at and the tokenizer does not.
OTHER_WHITE = re.compile("[\x1c-\x1f]")


def vocabulary(name: str) -> str:
    """Where a vocabulary file is on this machine: a path as it is, else a name of the installed package."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """The ids of a word as little-endian unsigned 32-bit numbers; the cache is emptied at ``most`` words.

    The word tokenizer puts a text in NFC and lower case, drops white space and cuts words by a pattern; none of its tokens
    crosses white space or the pattern's pieces, so a text's ids are those of its pieces, one after the other, and the
    pieces go straight to its merges. Texts where lower case in Python might differ from the tokenizer's (not in NFC before
    or after, a capital sigma), or that may hold special tokens or odd white space, go to the tokenizer as they are.
    """

    def __init__(self, name: str, most: int = 300_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(vocabulary(name)), most
        with open(vocabulary(name)) as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.find = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.merge = self.tokenizer.model.tokenize
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow at 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [n for n in range(256) if n not in plain]
        self.letters = {n: chr(n) for n in plain} | {n: chr(256 + k) for k, n in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            found = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.merge(found)]).tobytes()
        elif len(pieces := self.find(word)) == 1:
            ids = array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))]).tobytes() if pieces[0] == word else self[pieces[0]]
        else:
            ids = b"".join(map(self.__getitem__, pieces))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        low = text.lower()
        if "<|" in text or "\u03a3" in text or OTHER_WHITE.search(text) or not (is_normalized("NFC", text) and is_normalized("NFC", low)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, low.split()))


@lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    return WordIds(name)


class PieceCounts(dict):
    """The number of tokens of a pre-token of a byte-level vocabulary of ranks; emptied at ``most`` pre-tokens."""

    def __init__(self, name: str, most: int = 300_000):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        super().__init__()
        with open(vocabulary(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("siltline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pattern = regex.compile(public_tokenizers.PATTERN)
        self.find, self.scan, self.most = pattern.findall, pattern.finditer, most

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.find(text)))


@lru_cache(maxsize=2)
def piece_counts(name: str) -> PieceCounts:
    return PieceCounts(name)
