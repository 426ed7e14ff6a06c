import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselens.llm import matrix_packing as M
from caselens.llm import online_packing as O
from caselens.llm import tokens

TEXTS = [None, "", "a", "The cat, sat. on THE mat it's 42 <|endoftext|> x", "naïve café ÀÉ İstanbul ß 漢字 \x1c odd\x85space", "word " * 3000, "the cat", "the cat", "é combining  \t\n x_y __ 's don't"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece string, length int")


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [0]


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_word_memory_gives_the_tokenizers_ids(text):
    enc = tokens.encoder(tokens.default_vocabulary())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids_of(text)[:-1]


def test_online_packing_is_whole_and_gapless(docs):
    rows = O.pack_documents(docs).collect()
    for i, text in enumerate(TEXTS):
        ids, mine = ids_of(text), sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == list(range(0, len(ids), 2048))
        assert sum(r.length for r in mine) == len(ids)
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert O.pack_documents(none).count() == 0 and M.packed_matrix(none).count() == 0


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_open_bins_take_the_fullest_that_fits(lengths, most):
    bins, plain = O.OpenBins(50, most), []
    for n in lengths:
        at, offset = bins.place(n)
        fits = [b for b in plain if b[1] + n <= 50]
        best = max((b[1] for b in fits), default=0)
        if not fits and len(plain) == most:
            plain.remove(max(plain, key=lambda b: b[1]))
        assert offset == best
        if fits:
            taken = min(b for b in fits if b[1] == best)  # the one opened first
            assert at == taken[0]
            taken[1] += n
        else:
            plain.append([at, n])
        plain = [b for b in plain if b[1] < 50]


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=100, deadline=None)
def test_best_fit_decreasing(lengths):
    bins = M.best_fit_decreasing(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    left, count = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [x for x in left if x >= n]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - n)
        else:
            count += 1
            left.append(64 - n)
    assert len(bins) == count


def test_matrix_restores_every_document(spark, docs, tmp_path):
    M.write_matrix(M.packed_matrix(docs, block_tokens=2000), str(tmp_path / "m"))
    packed = spark.read.parquet(str(tmp_path / "m"))
    for r in packed.collect():
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 2048 and r.position_resets == r.cu_seqlens[:-1]
        assert len(r.input_ids) == 2 * r.n_tokens
    got = {}
    for r in sorted(M.unpack(packed).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(bytes.fromhex(r.ids_hex), "<u2").tolist())
    assert got == {i: ids_of(t) for i, t in enumerate(TEXTS)}
    padded = M.packed_matrix(docs, pad=9).first()
    assert len(padded.input_ids) == 2 * 2048
