"""Packing, token counts and the SentencePiece codec against the tokenizer libraries."""

import hashlib
import itertools
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skyledger.llm import common, packing, piece_codec, queries, token_count, word_bpe

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def odd_words():
    """Every seventh character of the basic plane below the surrogates, inside a word."""
    return ["a" + chr(c) + "B1" for c in range(0x1, 0xD800, 7)] + ["'tis we'll !!'s _a_ ２３ Ⅷ ΑΣ Σας é́ ´ ^", "a" * 3000]


def test_word_tokens_equal_the_library(library):
    encoder, merger = packing.encoder(WORDS), token_count.merger(WORDS)
    for text in odd_words():
        want = library.encode(text, add_special_tokens=False).ids
        assert np.array(want, "<u4").tobytes() == encoder.encode(text), text
        assert merger.count(text) == len(want), text


def test_token_counts(docs, library):
    got = token_count.token_counts(docs, limit=100).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(got) == docs.count()
    for r in got:
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)


def test_groups_are_bounded_for_null_and_repeated_ids(spark):
    rows = [(None if i % 3 else 5, 0, 1 + i % 50) for i in range(3000)]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, piece int, length long, _salt long")
    packed = packing.best_fit_pack(table.repartition(4), capacity=64, rows_per_group=100)
    assert packed.columns == [*table.columns, "sequence_id", "offset"]
    got = packed.collect()
    assert sorted(r._salt for r in got) == list(range(3000))
    group = [r.sequence_id >> 32 for r in got]
    assert len(set(group)) == 30 and max(map(group.count, set(group))) < 200


def test_packing_holds_every_piece_once(docs, library):
    cap = 64
    packed = packing.pack_documents(docs, capacity=cap, rows_per_group=40)
    rows = packed.collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        own = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
        assert r.start == r.piece * cap and r.length == min(cap, len(ids) - r.start)
        assert bytes(r.ids) == own and r.ids_crc32 == zlib.crc32(own)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0] + [n for _, n in spans[:-1]]))
        assert sum(n for _, n in spans) <= cap
    total = sum(r.length for r in rows)
    assert sum(-(-(len(library.encode(t or "", add_special_tokens=False).ids) + 1) // cap)
               for t in [r.text for r in docs.select("text").collect()]) == len(rows)
    groups = len({s >> 32 for s in bins})
    assert len(bins) <= total / cap * 1.05 + 2 * groups
    whole = packing.packed_sequences(packed).collect()
    assert len(whole) == len(bins)
    assert all(len(w.ids) == 4 * w.n_tokens == 4 * sum(n for _, n in bins[w.sequence_id]) for w in whole)


def test_best_fit_equals_a_plain_search():
    rnd = random.Random(5)
    for capacity in (10, 64, 2048):
        sizes = sorted((rnd.randint(1, capacity) for _ in range(400)), reverse=True)
        rooms = []
        plain = []
        for s in sizes:
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
                plain.append(min(fits))
            else:
                rooms.append(capacity - s)
                plain.append(capacity)
        bins, offsets = packing.pack_group(np.array(sizes), capacity)
        assert max(bins) + 1 == len(rooms)
        assert [capacity - o for o in offsets] == plain


def test_too_large_rows_are_an_error():
    with pytest.raises(ValueError):
        packing.pack_group(np.array([11, 3]), 10)


def test_piece_codec_equals_the_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = piece_codec.encode_documents(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode(texts[r.doc_id])
        assert list(r.ids) == want and r.decoded == library.decode(want)


def test_a_worker_hands_back_what_the_last_operator_held():
    script = """
from pathlib import Path
from skyledger.llm import common
held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
common.release()
rows = common.kept(("a",), lambda: [bytes([i % 256]) * 5000 for i in range(20_000)])
last = bytes(5000)  # stands above them in the heap
del rows
full = held()
common.release()
print(full - held())
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True,
                          cwd=Path(__file__).parents[2])
    assert int(done.stdout) > 60_000_000


def test_piece_codec_asks_for_the_prefixes_on_the_way_only():
    table = piece_codec.PrefixTable(PIECES)
    asked = []

    class Counted(dict):
        def __getitem__(self, pair):
            asked.append(pair)
            return table._compatible(*pair, len(table.by_text))

    table._pairs = Counted()
    text = ("▁information▁international▁the▁government" * 20)
    found = table.ids(text)
    assert found == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text.replace("▁", " ")[1:])
    assert len(asked) < len(text) / 2  # the whole table takes one at least for every prefix


def test_piece_codec_on_random_strings():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = piece_codec.codec(PIECES)
    rnd = random.Random(2)
    letters = "abcdeinorst ▁ABC.,;()'\n\t1é日🙂\x00"
    tokens = [codec.table.piece[i] for i in codec.table.parts]
    for n in range(3000):
        text = ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) if n % 2
                else "".join(rnd.choice(tokens) for _ in range(5)).replace("▁", " "))
        ids = library.encode(text)
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == library.decode(ids), text


def test_empty_tables(no_docs):
    assert token_count.token_counts(no_docs).collect() == []
    assert packing.pack_documents(no_docs).collect() == []
    assert piece_codec.encode_documents(no_docs).collect() == []
    assert piece_codec.encoding_digests(no_docs).collect() == []


def test_registered_queries_equal_the_libraries(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    counted = queries.QUERIES["op2_token_counts"](spark, sf).collect()
    coded = queries.QUERIES["op5_sentencepiece_codec"](spark, sf).collect()
    assert len(counted) == len(coded) == len(texts)
    words = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    for r in counted:
        n = len(words[r.doc_id])
        assert tuple(r) == (r.doc_id, len(texts[r.doc_id].encode()), n, n > 2048)
    for r in coded:
        ids = pieces.encode(texts[r.doc_id])
        assert tuple(r) == (r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids)))
    packed = queries.QUERIES["op1_best_fit_packing"](spark, sf)
    assert packed.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = packed.collect()
    want = []
    for d, ids in words.items():
        ids = [*ids, 0]
        want += [(d, k, at, len(ids[at:at + 2048]), zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes()))
                 for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_internal_names_in_the_input(spark):
    rows = [(i, 0, 3 + i, f"g{i}", i, -i, 7) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, length long, _group string, _size int, _salt int, offset int")
    packed = packing.best_fit_pack(table, capacity=64)
    assert packed.columns == ["doc_id", "piece", "length", "_group", "_size", "_salt", "sequence_id", "offset"]
    assert sorted(tuple(r)[:6] for r in packed.collect()) == sorted(r[:6] for r in rows)


def test_caches_are_bounded_by_bytes_and_one_operator_keeps_them():
    cache = common.RecentCache(str.upper, megabytes=1)
    for i in range(60_000):
        assert cache[f"word{i}"] == f"WORD{i}"
    assert 0 < len(cache) <= (1 << 20) / cache.entry and 0 < len(cache.old) <= (1 << 20) / cache.entry
    first = common.kept(("a", 1), list)
    assert common.kept(("a", 1), list) is first
    common.kept(("b", 1), list)
    assert common.kept(("a", 1), list) is not first
    common.release()
    assert not common._kept


def test_words_and_pieces_share_a_cache():
    """A lower-case word is its own piece: met again with capitals or marks, it is not tokenized again."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain = ["".join(p) for p in itertools.islice(itertools.product(letters, repeat=4), 60_000)]
    encode = packing.WordEncoder(word_bpe.load(WORDS))
    tokenize, met = encode.tokenize, []
    encode.tokenize = lambda piece: met.append(piece) or tokenize(piece)
    for text in (" ".join(plain), " ".join(w + "," for w in plain), " ".join(w.title() for w in plain)):
        ids = encode.source.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == ids
    assert len(met) <= 60_100  # some 120,000 with the pieces in a small cache of their own
