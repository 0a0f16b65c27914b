import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from novelscape.llm import packing, token_ids
from tests.llm import edge

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_ids_round_trip(spark, library, tmp_path):
    token_ids.write_ids(edge.frame(spark), str(tmp_path / "out"), PATH, ids_per_file=5000)
    got = [tuple(r) for r in token_ids.read_ids(spark, str(tmp_path / "out")).collect()]
    wanted = sorted(((d, len(ids := plain_ids(library, t)), crc(ids), ids) for d, t, *_ in edge.rows()), key=lambda r: edge.order(r[:3]))
    start, expected = 0, []
    for d, n, c, ids in wanted:
        expected.append((d, start, n, c, ids))
        start += n
    assert sorted(got, key=lambda r: r[1]) == expected


def test_frequent_ids_take_one_byte(spark, tmp_path):
    token_ids.write_ids(edge.frame(spark, [(1, "a b " * 300, None, None)]), str(tmp_path / "out"), PATH)
    row = spark.read.parquet(str(tmp_path / "out/ids")).first()
    assert row.n_tokens == 601 and len(row.control) == 151 and len(row.data) == 604


def test_empty_table(spark, tmp_path):
    token_ids.write_ids(edge.frame(spark, []), str(tmp_path / "out"), PATH)
    assert token_ids.read_ids(spark, str(tmp_path / "out")).collect() == []
    assert packing.pack_documents(edge.frame(spark, []), PATH).collect() == []


@pytest.fixture(scope="module")
def encoder():
    return token_ids.WordEncoder(open(PATH, encoding="utf-8").read(), "<|startoftext|>", 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,<|>ſİßsSéÉẞ́")), max_size=40), min_size=1, max_size=5))
def test_words_encode_as_texts(encoder, library, texts):
    ids, starts = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [plain_ids(library, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=6))
def test_coding_round_trip(runs):
    sizes, flat = np.array([len(r) for r in runs], dtype=np.int64), np.array([x for r in runs for x in r], dtype=np.uint32)
    control, control_ends, data, data_ends = token_ids.pack(flat, sizes)
    assert token_ids.unpack(control, data, sizes, token_ids.lookup_table()).tolist() == flat.tolist()
    assert len(control_ends) == len(data_ends) == len(runs)


def test_forgetting_keeps_ids(library, monkeypatch):
    monkeypatch.setattr(token_ids, "REMEMBERED", 5)
    own = token_ids.WordEncoder(open(PATH, encoding="utf-8").read(), "<|startoftext|>", 1)
    for text in ["one two three four five six", "two three seven", "two eight nine ten", "two three one"] * 3:
        assert own.encode(pa.array([text]))[0].tolist() == plain_ids(library, text)


def check_packing(library, rows, got, capacity):
    whole = sorted((d, len(ids := plain_ids(library, t)), ids) for d, t, *_ in rows if d is not None)
    pieces = sorted((d, p * capacity, ids[p * capacity : (p + 1) * capacity]) for d, n, ids in whole for p in range(-(-n // capacity)))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((d, s, len(x), crc(x)) for d, s, x in pieces)
    by = {}
    for r in got:
        assert r.start == r.piece * capacity
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return len(by), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize("group", [16, 8192])
def test_packing(spark, library, group):
    capacity = 64
    got = packing.pack_pieces(packing.pieces(edge.frame(spark), PATH, capacity), capacity, group).collect()
    used, least = check_packing(library, edge.rows(), got, capacity)
    assert used <= least * 1.06 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_local_search_never_worsens(sizes):
    sizes = np.array(sizes)
    first, then = packing.best_fit(sizes, 50), packing.packed(sizes, 50)
    assert np.bincount(then, weights=sizes).max() <= 50
    assert len(np.unique(then)) <= len(np.unique(first))


def test_local_search_empties_a_bin():
    sizes = np.array([6, 4, 4, 6, 5, 5])
    bins = np.array([0, 0, 1, 2, 1, 3])
    assert len(np.unique(packing.improved(sizes, bins, 10))) == 3
