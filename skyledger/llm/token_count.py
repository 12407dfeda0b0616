"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece form a doubly linked list; a heap holds the adjacent
pairs that have a merge rank. The lowest rank (leftmost on ties) is popped and
merged until no pair is left. A piece counts its initial symbols minus its
merges, so no identifiers are made.
"""

from __future__ import annotations

import heapq

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import RecentCache, arrow_map, id_text, kept
from .word_bpe import WordBpeFile, load, words

DEFAULT_TOKENIZER = "word_bpe_49k.json"


class PairMerger:
    """Counts the tokens of words under one tokenizer file."""

    def __init__(self, source: WordBpeFile):
        self.source = source
        ids: dict[str, int] = {}
        self.symbol = ids
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        for rank, (left, right) in enumerate(source.merges):
            self.rank.setdefault((number(left), number(right)), (rank, number(left + right)))
        self.by_piece = RecentCache(self.merged_length, 48)
        self.by_word = RecentCache(self._count_word, 48)

    def merged_length(self, piece: str) -> int:
        """Tokens of one byte-level piece: symbols minus merges."""
        n, suffix, ids = len(piece), self.source.suffix, self.symbol
        # Symbols that no merge names get numbers of their own and never merge.
        sym = [ids.get(c, -1) for c in piece]
        sym[-1] = ids.get(piece[-1] + suffix, -1)
        rank = self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = rank.get((sym[i], sym[i + 1]))
            if found:
                heap.append((found[0], i, sym[i], sym[i + 1], found[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = nxt[i] if sym[i] == left else n
            if j >= n or sym[j] != right:
                continue  # one of the two was merged meanwhile
            count -= 1
            sym[i], sym[j] = merged, -2
            after = nxt[i] = nxt[j]
            if after < n:
                prv[after] = i
                found = rank.get((merged, sym[after]))
                if found:
                    heapq.heappush(heap, (found[0], i, merged, sym[after], found[1]))
            before = prv[i]
            if before >= 0:
                found = rank.get((sym[before], merged))
                if found:
                    heapq.heappush(heap, (found[0], before, sym[before], merged, found[1]))
        return count

    def _count_word(self, word: str) -> int:
        pieces, specials = self.source.pieces(word)
        return specials + sum(map(self.by_piece.__getitem__, pieces))

    def count(self, text: str) -> int:
        return sum(map(self.by_word.__getitem__, words(text)))


def merger(path: str) -> PairMerger:
    """The worker's own, with its caches."""
    return kept(("merger", path), lambda: PairMerger(load(path)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer_path: str | None = None, limit: int = 2048) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts equal those of the ``tokenizers`` library without added special
    tokens; special strings inside a text count as one token each, as is the
    library's default. Null text counts as empty (0 bytes, 0 tokens); a null id
    is kept; repeated rows give repeated results; an empty table gives an empty
    result; further columns, also any named like the results, are ignored.
    """
    path = tokenizer_path or public_tokenizers.path(DEFAULT_TOKENIZER)

    def run(batch: pa.RecordBatch) -> dict:
        count = merger(path).count
        n_bytes, n_tokens = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            n_bytes.append(len(text.encode()))
            n_tokens.append(count(text))
        return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens,
                "over_limit": [n > limit for n in n_tokens]}

    return arrow_map(id_text(docs, id_col, text_col), run,
                     "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
