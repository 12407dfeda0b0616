"""Near-duplicates, repeated passages and vectors against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from conftest import SMALL_SF

from skyledger.llm import components, queries, simhash, suffix_dedup, vector_join


def closure(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


# --- SimHash ------------------------------------------------------------------------

def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(texts):
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_components(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    label = closure(len(rows), pairs)
    least = {}
    for r, g in zip(rows, label):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = sorted(((str(r.doc_id), p, least[g]) for r, p, g in zip(rows, prints, label)))
    got = sorted((str(r.doc_id), r.bits % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def random_bits(n, groups):
    r = np.random.default_rng(n)
    base = r.integers(0, 2**64, groups, dtype=np.uint64)
    bits = base[r.integers(0, groups, n)]
    for _ in range(3):
        flip = r.integers(0, 64, n).astype(np.uint64)
        bits ^= (r.integers(0, 2, n).astype(np.uint64) << flip)
    return np.unique(bits)


def test_links_in_chunks_of_a_hot_block(spark):
    bits = random_bits(700, 6)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    label = closure(len(bits), [(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j])
    table = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "bits long").repartition(3)
    roots = {r.node: r.root for r in components.connected_components(simhash.links(table, chunk_rows=50)).collect()}
    own = [int(b) for b in bits.view(np.int64)]
    groups = {}
    for b, g in zip(own, label):
        groups.setdefault(g, []).append(b)
    for members in groups.values():
        assert {roots.get(b, b) for b in members} == {min(members)}


def test_components_of_chains_stars_and_nothing(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (500, 400)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 400: 400, 500: 400}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffix arrays --------------------------------------------------------------------

def plain_repeats(rows, length):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if d is not None and d < first.get(w, d + 1):
                first[w] = d
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            owner = first.get(raw[i:i + length])
            if owner is not None and (d is None or owner < d):
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((str(d), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digests(docs, **options):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in suffix_dedup.kept_digests(docs, **options).collect())


def test_repeated_passages(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert digests(docs) == plain_repeats(rows, 50)
    assert digests(docs, min_length=20) == plain_repeats(rows, 20)


def test_hot_names_are_dealt_by_window(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert digests(docs, hot_documents=2) == plain_repeats(rows, 50)


def test_flushing_keeps_names_together(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 333)
    rnd = random.Random(8)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(3000)), np.uint8)
    name, first, n = suffix_dedup.runs(data, 50, 16, 56)
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == len(data) - 49


def test_previous_factors_against_plain_search():
    rnd = random.Random(9)
    for depth in (5, 8, 13, 50):
        parts = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(depth, depth + 60))) for _ in range(12)]
        window, doc, at = [], [], 0
        for d, p in enumerate(parts):
            window += range(at, at + len(p) - depth + 1)
            doc += [d // 2] * (len(p) - depth + 1)
            at += len(p)
        data = b"".join(parts)
        got = suffix_dedup.previous_factors(np.frombuffer(data, np.uint8), np.array(window), np.array(doc), depth)
        cut = [data[w:w + depth] for w in window]
        common = lambda a, b: next((i for i in range(depth) if a[i] != b[i]), depth)
        want = [max([common(cut[i], cut[j]) for j in range(len(cut)) if doc[j] < doc[i]], default=0) for i in range(len(cut))]
        assert got.tolist() == want


def test_removed_texts_hold_whole_characters(docs):
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    spans = suffix_dedup.repeated_spans(docs)
    assert spans.columns == [*docs.columns, "removed_spans"]
    assert sorted((str(r.doc_id), sum(s.end - s.start for s in r.removed_spans), len(r.removed_spans))
                  for r in spans.collect()) == [(d, m, n) for d, _, m, n, _ in digests(docs)]
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in cut.collect():
        assert r.text is None or len(r.text) <= len(before[r.doc_id])
        assert r.text == before[r.doc_id] or r.n_chars == len(r.text)
    assert suffix_dedup.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)]
    assert suffix_dedup.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]


# --- vectors ----------------------------------------------------------------------------

def plain_vectors(rows, threshold=0.9):
    usable = [i for i, (v, e) in enumerate(rows) if v is not None and e and None not in e
              and all(np.isfinite(e)) and any(e)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in usable}
    pairs = [(i, j) for i in usable for j in usable if i != j and unit[i] @ unit[j] >= threshold]
    label = closure(len(rows), pairs)
    links = [0] * len(rows)
    for i, _ in pairs:
        links[i] += 1
    ids = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            ids[label[i]] = min(ids.get(label[i], v), v)
    return sorted((str(v), links[i], str(ids.get(label[i])), v is not None and ids[label[i]] == v)
                  for i, (v, _) in enumerate(rows))


def test_vector_links(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(25, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 25] + r.normal(size=12) * 0.25]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(9)] + [(400, None), (401, []), (402, [0.0] * 12),
             (403, [float("nan")] + [1.0] * 11), (404, [None] + [1.0] * 11), (None, rows[0][1]), (405, [float("inf")] * 12)]
    r.shuffle(rows)
    rows = [(None if v is None else int(v), e) for v, e in rows]
    table = spark.createDataFrame([(v, e, 1, 2) for v, e in rows],
                                  "vec_id long, embedding array<float>, kept int, block int").repartition(3)
    for block_rows in (37, 4096):
        got = sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept)
                     for x in vector_join.near_vectors(table, block_rows=block_rows).collect())
        assert got == plain_vectors(rows)


def test_empty_tables(spark, no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.first_of_each_group(no_docs).collect() == []
    assert suffix_dedup.repeated_spans(no_docs).collect() == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_join.near_vectors(empty).collect() == []
    unusable = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vector_join.near_vectors(unusable).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_queries_over_driver_tables(spark):
    rows = spark.read.parquet(f"{SMALL_SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op4_suffix_array_dedup"](spark, SMALL_SF).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) \
        == plain_repeats([(r.doc_id, r.text) for r in rows], 50)
    prints = [plain_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    label = closure(len(rows), pairs)
    least = {}
    for r, g in zip(rows, label):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    got = queries.QUERIES["op9_simhash_near_dedup"](spark, SMALL_SF).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, label))
    vectors = spark.read.parquet(f"{SMALL_SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.QUERIES["op8_embedding_near_dedup"](spark, SMALL_SF).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in got) \
        == plain_vectors([tuple(v) for v in vectors])


def test_internal_names_in_the_input(spark):
    """Columns named like internal ones come through as they are, in any case of letters."""
    shared = "a passage of more than fifty bytes that two of the documents have in common. "
    rows = [(1, 777, "one " + shared, 5, 6.5, "x"), (2, 778, shared + "two", 7, 8.5, "y"), (3, 779, None, 9, 1.5, None)]
    names = ["doc_id", "_d", "text", "n_chars", "_place", "c0"]
    for more in (["_name", "_found", "_bits", "_row", "C1"], ["_names", "_copies", "d", "name", "_D2"]):
        table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows],
                                      "doc_id long, _d int, text string, n_chars long, _place double, c0 string, "
                                      + ", ".join(f"{m} int" for m in more))
        kept = suffix_dedup.without_repeats(table)
        assert kept.columns == [*names, *more]
        got = {r[0]: tuple(r) for r in kept.collect()}
        assert got[1] == (*rows[0], 1, 2, 3, 4, 5) and got[3] == (*rows[2], 1, 2, 3, 4, 5)
        assert got[2] == (2, 778, "two", 3, 8.5, "y", 1, 2, 3, 4, 5)
        found = suffix_dedup.repeated_spans(table)
        assert found.columns == [*names, *more, "removed_spans"]
        assert {r[0]: len(r[-1]) for r in found.collect()} == {1: 0, 2: 1, 3: 0}
        first = simhash.first_of_each_group(table)
        assert first.columns == [*names, *more]
        assert sorted(tuple(r) for r in first.collect()) == sorted((*r, 1, 2, 3, 4, 5) for r in rows)


def test_a_suffix_sort_stays_small():
    n = suffix_dedup.FLUSH_BYTES
    data = np.random.default_rng(0).integers(97, 101, n + 50, dtype=np.uint8)
    tracemalloc.start()
    suffix_dedup.previous_factors(data, np.arange(n), np.arange(n) % 7, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


@pytest.mark.parametrize("prefix", [b"", b"the same sixteen bytes and more "])
def test_suffix_order_sorts_tails_of_equal_heads_only(prefix, monkeypatch):
    """The order of a whole sort, with few numbers sorted where the first bytes tell windows apart."""
    rng, sorted_numbers, lexsort = np.random.default_rng(4), [], np.lexsort
    texts = [prefix + bytes(rng.integers(97, 99 if prefix else 123, 50 - len(prefix)).tolist()) for _ in range(300)]
    texts = np.frombuffer(b"".join(texts[i] + bytes(6) for i in rng.integers(0, 300, 2000)), ">u8").reshape(2000, 7)
    columns, doc = list(texts.T.astype(np.uint64)), rng.integers(0, 40, 2000)
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_numbers.extend(map(len, keys)) or lexsort(keys))
    order = suffix_dedup._suffix_order(columns, doc)
    whole = lexsort((doc, *reversed(columns)))
    for c in (*columns, doc):
        assert (c[order] == c[whole]).all()
    assert sorted(order.tolist()) == list(range(2000))
    assert prefix or sum(sorted_numbers) < 3 * 2000  # eight numbers a window before


def test_spans_of_several_documents_at_once():
    """Spans of one suffix task: apart per (d, text_key), merged within, in order."""
    fake = type("Fake", (), {"repartition": lambda s, *a: s, "sortWithinPartitions": lambda s, *a: s,
                             "mapInArrow": lambda s, run, schema: run})()
    rows = [(9, 2, 1, 40, 3), (9, 1, 1, 0, 2), (9, 1, 1, 52, 1), (9, 1, 7, 5, 1), (9, 1, 1, 200, 4)]
    batch = suffix_dedup.record_batch(
        {c: [r[i] for r in rows] for i, c in enumerate(("deal", "d", "text_key", "start", "n"))} | {"bytes": [None] * 5},
        suffix_dedup._PIECE)
    out = [r for b in suffix_dedup._removed(fake, 50)(iter([batch])) for r in b.to_pylist()]
    found = {(r["d"], r["text_key"]): np.frombuffer(r["spans"], "<i8").reshape(-1, 2).tolist() for r in out}
    assert found == {(1, 1): [[0, 51], [52, 102], [200, 253]], (1, 7): [[5, 55]], (2, 1): [[40, 92]]}
