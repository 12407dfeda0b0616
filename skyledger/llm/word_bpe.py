"""Shared reading of a ``tokenizers`` word-BPE file: words, pieces, specials.

A text is cut at white space (the file's normaliser folds white space and its
splitter drops it, so no merge or normalisation crosses it) and every word is
handled once per worker through a bounded cache.
"""

from __future__ import annotations

import json
import re

from tokenizers import Tokenizer

# White space as the tokenizer files see it: Python's own set without U+001C..U+001F.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_WORDS_KEEPING_SEPARATORS = re.compile(r"(?:\S|[\x1c-\x1f])+")
# Words of printable ASCII and Latin-1 letters: composed already, with one-to-one
# lower case, so the file's splitter reads like this pattern on them.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """Byte-level letters: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    letters, spare = [], 0x100
    for b in range(256):
        itself = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD
        letters.append(chr(b if itself else spare))
        spare += not itself
    return letters


_LETTERS = dict(enumerate(_byte_letters()))


def words(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return _WORDS_KEEPING_SEPARATORS.findall(text)
    return text.split()


def plain_pieces(word: str) -> list[str]:
    """Byte-level pieces of a plain word."""
    found = _PLAIN_PIECES.findall(word.lower())
    if not word.isascii():
        found = [p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS) for p in found]
    return found


class WordBpeFile:
    """Parts of the tokenizer file that the operators need, loaded once per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
                       for m in spec["model"]["merges"]]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def plain(self, word: str) -> bool:
        return _PLAIN.fullmatch(word) is not None and "<|" not in word

    def pieces(self, word: str) -> tuple[list[str], int]:
        """Byte-level pieces of a word, and how many special tokens stand in it."""
        if self.plain(word):
            return plain_pieces(word), 0
        parts = self.special.split(word) if self.special else [word]
        out: list[str] = []
        for part in parts:
            if part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out, len(parts) - 1


def load(path: str) -> WordBpeFile:
    return WordBpeFile(path)
