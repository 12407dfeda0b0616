"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text there is exactly one token that ends the prefix's
encoding. An automaton over the vocabulary reports the tokens that end at each
position; the one whose predecessor in the table forms a compatible pair with
it (merging would never have crossed the border between them) is stored.
Only prefixes that the whole text's own token and its pair tests lead to are
filled in. Ids are then read backwards from the end of the text.
"""

from __future__ import annotations

import hashlib
import re
from operator import add

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import RecentCache, arrow_map, id_text, kept

DEFAULT_MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # fixed value: the visible space of SentencePiece vocabularies


class PrefixTable:
    """Vocabulary, merge history and pair tests of one merge-type model."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i)
                                              or model.is_unknown(i) or model.is_unused(i))]
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown_id = model.unk_id()
        self.single = {self.piece[i]: i for i in normal if len(self.piece[i]) == 1}
        self.shown = {i: self.piece[i].replace(SPACE, " ") for i in range(n)
                      if i not in self.byte_of and i not in self.silent and i != self.unknown_id}
        # Rank: when a token is merged; characters are there from the start.
        merged = sorted((i for i in normal if len(self.piece[i]) > 1), key=lambda i: -model.get_score(i))
        self.rank = dict.fromkeys(self.single.values(), -1) | {i: r for r, i in enumerate(merged)}
        by_text = {self.piece[i]: i for i in self.rank}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.by_text = by_text
        self._pairs = RecentCache(lambda key: self._compatible(key[0], key[1], len(by_text)), 96, entry=200)
        self._learn_merges(merged)
        self.automaton = ahocorasick.Automaton()
        for i in self.rank:
            if len(self.piece[i]) == 1 or i in self.parts:
                self.automaton.add_word(self.piece[i], i)
        self.automaton.make_automaton()
        self.width = list(map(len, self.piece))
        # Of the tokens that end another one, the longest: they all match where that one does.
        self.shorter = {token: next((end for at in range(1, len(self.piece[token]))
                                     if (end := self.by_text.get(self.piece[token][at:])) is not None
                                     and (self.width[end] == 1 or end in self.parts)), None)
                        for token in self.automaton.values()}

    def _learn_merges(self, merged: list[int]) -> None:
        """The two tokens each token is merged from; tokens that merging never reaches get none."""
        for token in merged:
            text = self.piece[token]
            for cut in range(1, len(text)):
                left, right = self.by_text.get(text[:cut]), self.by_text.get(text[cut:])
                if left is None or right is None:
                    continue
                self.joined[left, right] = self.rank[token]
        for token in merged:
            text = self.piece[token]
            for cut in range(1, len(text)):
                left, right = self.by_text.get(text[:cut]), self.by_text.get(text[cut:])
                if (left is not None and right is not None and self._made(left, token) and self._made(right, token)
                        and self._compatible(left, right, self.rank[token])):
                    self.parts[token] = left, right
                    break

    def _made(self, part: int, whole: int) -> bool:
        rank = self.rank[part]
        return rank < 0 or rank < self.rank[whole] and part in self.parts

    def _compatible(self, left: int, right: int, before: int) -> bool:
        """Do ``left`` and ``right`` stay apart under all merges of a rank below ``before``?

        Undoes the later of the two sides' last merges again and again. The
        tokens then at the border were neighbours until the undone merge, so a
        merge of the two of an earlier rank (of the same rank too, if the
        undone merge lies further right) would have come first.
        """
        while True:
            crossing = self.joined.get((left, right))
            if crossing is not None and crossing < before:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.parts[left][1]
            else:
                before, right = b + 1, self.parts[right][0]

    def ids(self, text: str) -> list[int]:
        """Token ids of ``text``, in which spaces are already visible spaces."""
        single = self.single
        if all(map(single.__contains__, text)):
            return self._known_ids(text)
        out: list[int] = []
        at = 0
        for stop, char in enumerate(text):
            if char not in single:  # no token holds it: bytes, and a border for merging
                out += self._known_ids(text[at:stop])
                out += [self.byte_id[b] for b in char.encode()] if self.byte_id else [self.unknown_id]
                at = stop + 1
        return out + self._known_ids(text[at:] if at else text)

    def _known_ids(self, text: str) -> list[int]:
        if not text:
            return []
        # By the place of the last character; matches come longest first, and the first one stays.
        likely = dict(reversed(list(self.automaton.iter(text))))
        last: dict[int, int] = {}
        pairs, width, shorter = self._pairs, self.width, self.shorter
        todo = [len(text) - 1]
        while todo:  # only prefixes that a pair test asks for are filled in
            end = todo[-1]
            token = likely[end]
            while (at := end - width[token]) >= 0:
                before = last.get(at)
                if before is None:
                    likely[end] = token
                    todo.append(at)
                    break
                if pairs[before, token]:
                    at = -1
                    break
                token = shorter[token]
            if at < 0:
                last[end] = token
                todo.pop()
        out, end = [], len(text) - 1
        while end >= 0:
            token = last[end]
            out.append(token)
            end -= width[token]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, the marker space in front still there."""
        try:
            return "".join(map(self.shown.__getitem__, ids))
        except KeyError:  # bytes, unknown or silent ids among them
            pass
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i == self.unknown_id:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.shown[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


class TextCodec:
    """Whole texts, cut where no token of the vocabulary can lie across.

    Visible spaces only start tokens or follow each other, and a border between
    two characters that are never neighbours in any token is never merged over;
    the words between are encoded once per worker through a bounded cache.
    """

    def __init__(self, path: str):
        self.table = PrefixTable(path)
        tokens = [self.table.piece[i] for i in self.table.rank]
        self.neighbours = {t[i:i + 2] for t in tokens for i in range(len(t) - 1)}
        inner_space = any(b == SPACE != a for a, b in self.neighbours)
        whole = any("\n" in t for t in tokens)
        self.cut = re.compile(r"(?s:.+)" if inner_space or whole else r" *[^ \n]+| +|\n")
        self.by_part = RecentCache(lambda s: tuple(self.table.ids(s)), 32, entry=240)
        self.by_word = RecentCache(self._word, 96, entry=360)

    def _word(self, word: str) -> tuple[int, str, str]:
        word = word.replace(" ", SPACE)
        joined = list(map(self.neighbours.__contains__, map(add, word, word[1:])))
        if False in joined:
            ids: list[int] = []
            at = 0
            for i, inside in enumerate(joined, 1):
                if not inside:
                    ids += self.by_part[word[at:i]]
                    at = i
            ids += self.by_part[word[at:]]
        else:
            ids = self.table.ids(word)
        return len(ids), ",".join(map(str, ids)), self.table.decode(ids)

    def words(self, text: str) -> list[tuple[int, str, str]]:
        """Per word: number of ids, ids as text, decoded text."""
        if not text:
            return []
        return list(map(self.by_word.__getitem__, self.cut.findall(" " + text.replace(SPACE, " "))))

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.words(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        text = self.table.decode(ids)
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> TextCodec:
    """The worker's own, with its caches."""
    return kept(("codec", path), lambda: TextCodec(path))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     model_path: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every row.

    Ids are those of the sentencepiece library without begin or end ids.
    Null text counts as empty: no ids, empty decoded text. Null ids and
    repeated rows are kept, further columns are ignored, an empty table gives
    an empty result.
    """
    path = model_path or public_tokenizers.path(DEFAULT_MODEL)

    def run(batch: pa.RecordBatch) -> dict:
        use = codec(path)
        texts = [t.as_py() or "" for t in batch.column("text")]
        ids = [use.encode(t) for t in texts]
        return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [use.decode(i) for i in ids]}

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     model_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of :func:`encode_documents`' results.

    Taken where the ids are made, so no id leaves the task.
    """
    path = model_path or public_tokenizers.path(DEFAULT_MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batch: pa.RecordBatch) -> dict:
        use = codec(path)
        out: dict = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch.column("text"):
            counts, ids, decoded = zip(*(use.words(text.as_py() or "") or [(0, "", "")]), strict=True)
            out["n_tokens"].append(sum(counts))
            out["ids_sha256"].append(sha(",".join(ids)))
            out["decoded_sha256"].append(sha("".join(decoded).removeprefix(" ")))
        return out

    return arrow_map(id_text(docs, id_col, text_col), run,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
