"""Operators 1, 7 and 9 share the tokenizer: whole texts against the tokenizers library."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from layerkit.llm import bpe, packing, token_files
from layerkit.llm.tokens import ChunkEncoder, default_tokenizer
from layerkit.session import scratch_path, stage
from tests.llm.conftest import ODD

PATH = default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


LONG = "word " * 30_000 + "x" * 5000


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("ab!? '\n.,dlsΣ", max_size=40)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_both_encoders_equal_the_library(texts):
    column = pa.array(texts, pa.string())
    want = [ids_of(t) for t in texts]
    flat, counts = ChunkEncoder.at(PATH).encode(column)
    assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    n, ids, decoded = bpe.PairIndexBpe.at(PATH).encode_block(column)
    assert n.tolist() == [len(w) for w in want]
    assert ids.to_pylist() == [" ".join(map(str, w)) for w in want]
    assert decoded.to_pylist() == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]


def test_pair_index_on_one_text():
    text = "Hello there, <|endoftext|> it's 2024!!!"
    own = bpe.PairIndexBpe.at(PATH)
    assert own.encode(text) == ids_of(text)
    assert own.decode(own.encode(text)) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


def test_places_of_a_word_are_merged_one_by_one_where_ranks_fall():
    own = bpe.PairIndexBpe(PATH)
    own.stepwise[:] = True
    for word in ("!!!!!!!!!!!??", "aaaaaaaaaaa", "bananabananas"):
        assert own.encode(word) == ids_of(word)


def test_encode_decode_rows(docs):
    rows = [*ODD, (11, LONG)]
    found = bpe.encode_decode(docs(rows), digests=True).collect()
    want = Counter()
    for i, t in rows:
        ids = ids_of(t)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False))]
        want[(i, len(ids), *sha)] += 1
    assert Counter(map(tuple, found)) == want
    assert bpe.encode_decode(docs([])).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
@given(st.integers(1, 40), st.integers(1, 9), st.integers(0, 32), st.randoms(use_true_random=False))
@settings(max_examples=30, deadline=None)
def test_blocks_come_back(share, size, count, bits, random):
    ids = np.array([[random.getrandbits(bits) if bits else 0 for _ in range(size)] for _ in range(count)], np.uint32)
    packed = token_files.pack_blocks(ids, share)
    starts = np.cumsum([0, *map(len, packed)])[:-1].tolist()
    assert (token_files.unpack_blocks(b"".join(packed), starts, size) == ids).all()


def test_files_hold_all_documents_in_order(spark, docs):
    rows = [*ODD, (11, LONG), *[(100 + i, f"text number {i} " * i) for i in range(60)]]
    shards = stage(token_files.write_token_files(docs(rows), scratch_path(spark, "t"), block=64), "shards")
    found = token_files.read_token_files(shards).collect()
    found.sort(key=lambda r: r.start)
    order = [i for i, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [r.doc_id for r in found] == order
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((i, (*ids_of(t), 2)) for i, t in rows)
    digests = token_files.read_token_files(shards, "ids_crc32 long", token_files.ids_crc32).collect()
    assert {(r.start, r.ids_crc32) for r in digests} == {(r.start, crc(r.ids)) for r in found}


def test_one_document_is_found_by_the_block_index(spark, docs, tmp_path):
    rows = [(i, f"some words {i} " * (i * 40)) for i in range(12)]
    shards = stage(token_files.write_token_files(docs(rows, 1).coalesce(1), scratch_path(spark, "t"), block=32, end_id=None), "shards").collect()
    for shard in shards:
        with open(shard.path.removeprefix("file://"), "rb") as source:
            reader = token_files.ShardReader(source, source.seek(0, 2))
            for at, doc_id in enumerate(reader.doc_ids):
                assert reader.document(at).tolist() == ids_of(rows[doc_id][1])


def test_no_documents_make_no_file(spark, docs):
    shards = stage(token_files.write_token_files(docs([]), scratch_path(spark, "t")), "shards")
    assert shards.count() == 0 and token_files.read_token_files(shards).count() == 0


def check_packing(found, rows, capacity):
    by_doc = Counter()
    for r in found:
        by_doc[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
    want = Counter()
    for i, t in rows:
        ids = [*ids_of(t), 0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            want[(i, n, at, len(piece), crc(piece))] += 1
    assert by_doc == want
    filled = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= capacity
    return len(filled)


def test_packing_places_every_piece(docs):
    rows = [*ODD, (11, LONG), *[(100 + i, "word " * (i * 37 % 90)) for i in range(200)]]
    found = packing.pack(docs(rows), capacity=100).collect()
    n = check_packing(found, rows, 100)
    assert n == packing.lower_bound(Counter(r.length for r in found), 100)
    assert packing.pack(docs([])).count() == 0


def test_packing_of_one_hot_length(docs):
    rows = [(i, None) for i in range(500)]
    assert check_packing(packing.pack(docs(rows), capacity=64).collect(), rows, 64) == 8


def smallest(counts, capacity):
    """Fewest bins by trying everything."""
    items = sorted(Counter(counts).elements(), reverse=True)
    best = len(items)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in {*rooms}:
            if r >= items[i]:
                left = list(rooms)
                left.remove(r)
                put(i + 1, [*left, r - items[i]])
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=120, deadline=None)
def test_bin_completion_against_all_packings(lengths):
    counts = Counter(lengths)
    plan = packing.complete_bins(counts, 20)
    used = Counter()
    for times, filling in plan:
        assert sum(filling) <= 20
        for k in filling:
            used[k] += times
    assert used == counts
    least = smallest(counts, 20)
    assert packing.lower_bound(counts, 20) <= least
    assert least <= sum(n for n, _ in plan) <= sum(n for n, _ in packing.best_fit(counts, 20))


def test_bin_completion_searches_long_enough():
    counts = {
        67: 1, 68: 2, 71: 1, 75: 1, 80: 1, 85: 1, 87: 3, 88: 2, 93: 3, 95: 1, 97: 2, 99: 3, 112: 1, 125: 4, 129: 3, 130: 1, 132: 1,
        136: 1, 137: 2, 138: 3, 155: 3, 176: 4, 178: 3, 202: 2, 210: 4, 213: 1, 214: 1, 218: 1, 224: 3, 227: 3, 240: 3, 241: 2, 242: 5, 244: 2,
    }
    assert sum(n for n, _ in packing.best_fit(counts, 500)) == 25
    assert sum(n for n, _ in packing.complete_bins(counts, 500)) == packing.lower_bound(counts, 500) == 24


def test_bin_completion_betters_best_fit_and_takes_tiny_lengths():
    counts = Counter({36: 5, 35: 7, 34: 6, 30: 9, 27: 8, 26: 7, 25: 6, 23: 5, 51: 3})
    size = lambda plan: sum(n for n, _ in plan)
    assert size(packing.complete_bins(counts, 100)) == packing.lower_bound(counts, 100) < size(packing.best_fit(counts, 100))
    assert size(packing.complete_bins({1: 10_000, 2: 3, 2000: 1}, 2048)) == 6
    with pytest.raises(ValueError):
        packing.complete_bins({30: 1}, 20)
