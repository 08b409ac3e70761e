import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from edgetide.llm import packing, token_store, tokens

ODD = ["", "  a", "a  b", "a   b ", "it's a don't 's 'store", "x\n\ny\n z\n", "\n \n", "a \n", "a  b", "日本 語です", "<|endoftext|> b", "tab\tx  ", "a\r\nb", "é é·x ÷×", "1a2b 3.4", "\n", " ", "x\n ", "word " * 3000, "a" * 5000, None]


def plain_ids(text):
    library = tokens.pieces(tokens.default_path()).library
    return (library.encode(text or "", add_special_tokens=False).ids if text else []) + [2]


def frame(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, ["x"] * len(texts)))
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_memory_of_pieces_equals_the_library():
    memory = tokens.pieces(tokens.default_path())
    for text, ids in zip(ODD, memory.encode_all(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(text)[:-1]


def test_pack_against_brute_force(spark):
    rows = packing.pack(frame(spark, ODD + ODD), tokens.default_path()).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    sequences = defaultdict(list)
    for k, text in enumerate(ODD + ODD):
        ids, at = plain_ids(text), 0
        for j, r in enumerate(sorted(pieces[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (j, at)
            assert r.length <= 1024 and (j == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            sequences[r.sequence_id].append((r.offset, r.length))
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024


def test_plan_keeps_every_constraint_and_packs_closely():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, 1025, 20_000), return_counts=True), strict=True)}
    for capacity in (packing.Capacity(), packing.Capacity(1024, 3, 500_000, rule="dot_product")):
        histogram_ = {n: c for n, c in histogram.items() if n <= capacity.longest()}
        used = defaultdict(lambda: np.zeros(3, np.int64))
        placed = defaultdict(int)
        for s, rank, n, first, offset in packing.plan(histogram_, capacity):
            assert rank == placed[s]
            placed[s] += n
            for q in range(first, first + n):
                assert used[q][0] == offset
                used[q] += (s, 1, s * s)
        assert placed == histogram_
        assert all((u <= (capacity.tokens, capacity.documents, capacity.cost)).all() for u in used.values())
        if capacity.documents == 1024:
            assert len(used) <= 1.01 * sum(n * c for n, c in histogram_.items()) / 1024 + 1


def test_store_round_trip_order_and_ties(spark):
    texts, ids = ODD + ["same", "same", "other"], [*range(len(ODD), 0, -1), 100, 100, 100]
    rows = token_store.round_trip(frame(spark, texts, ids), tokens.default_path()).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(ids)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = sorted((i, zlib.crc32(np.array(plain_ids(t), "<u4").tobytes())) for i, t in zip(ids, texts))
    assert sorted((r.doc_id, r.ids_crc32) for r in rows) == want


def test_lookup_by_doc_id(spark, tmp_path):
    texts, ids = ODD + ["same", "other"], [*range(len(ODD)), 3, None]
    path = f"{tmp_path}/store"
    token_store.write(frame(spark, texts, ids), path, tokens.default_path(), file_tokens=40)
    want = sorted((str(i), plain_ids(t)) for i, t in zip(ids, texts) if i in (3, 5, None))
    got = token_store.lookup(spark, path, [3, 5, None, 10_000]).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert sorted((str(r.doc_id), r.ids) for r in token_store.read(spark, path).collect()) == sorted((str(i), plain_ids(t)) for i, t in zip(ids, texts))


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, tokens.default_path()).count() == 0
    assert token_store.round_trip(none, tokens.default_path()).count() == 0
    one = spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")
    assert packing.pack(one, tokens.default_path()).count() == 2
    assert [r.doc_id for r in token_store.round_trip(one, tokens.default_path()).collect()] == [None, None]


def test_a_reader_decompresses_only_the_frames_asked_for():
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 50_000, 5000).astype("<u4").tobytes() for _ in range(40)]
    content, seen = token_store.file_bytes(0, 0, list(range(40)), ids), []

    def read(a, b):
        seen.append((a, b))
        return content[a:b]

    store = token_store.Store(read, len(content))
    seen.clear()
    assert store.document(17).tobytes() == ids[17]
    assert len(seen) == 1 and seen[0][1] - seen[0][0] < len(content) / 5
    broken = bytearray(content)
    broken[int(store.at[1]) + 30] ^= 255
    store = token_store.Store(lambda a, b: bytes(broken[a:b]), len(broken))
    with pytest.raises(Exception):
        store.frame(1)
    assert content[-4:] == struct.pack("<I", token_store.SEEK_MAGIC)
