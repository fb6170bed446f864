"""Packing and token files against the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm.packing import SumOfSquaresPacker, pack_documents
from tickloom.llm.queries import op2_token_files, op10_packing
from tickloom.llm.text import ChunkEncoder
from tickloom.llm.token_files import SequenceReader, SequenceWriter, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x1f\x85\xa0 　a'sB9!,é日<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_encode_as_the_whole_text(text):
    whole = Tokenizer.from_file(PATH) if not hasattr(test_chunks_encode_as_the_whole_text, "t") else test_chunks_encode_as_the_whole_text.t
    test_chunks_encode_as_the_whole_text.t = whole
    whole.encode_special_tokens = True
    encoder = ChunkEncoder(PATH, most=50)
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_cache_may_overflow(library):
    encoder = ChunkEncoder(PATH, most=3)
    texts = ["a b c d e f", "a b", " lead", "x" * 5000, "", None, "two  spaces b", "line\nend \n b", "tail "]
    for batch in (texts, *([t] for t in texts)):
        for text, packed in zip(batch, encoder.encode(batch)):
            assert np.frombuffer(packed, encoder.dtype).tolist() == library(text)


def checked_pieces(pieces, ids_of, size):
    """Every id in one piece, windows gapless, at most one not full per partition."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_of)
    for doc_id, parts in by_doc.items():
        ids, at = ids_of[doc_id], 0
        for p in sorted(parts, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    open_windows = 0
    for parts in by_window.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        open_windows += at < size
    return open_windows


def test_query_packs_all_documents(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids_of = {r.doc_id: [*library(r.text), 0] for r in docs.collect()}
    assert checked_pieces(op10_packing(spark, DATA).collect(), ids_of, 1024) <= docs.rdd.getNumPartitions()


def test_packing_edge_cases(spark):
    schema = "doc_id long, text string, ids string, offset string, sequence_id string"
    rows = [(1, None, "x", "y", "z"), (2, "", None, None, None), (None, "a b", "", "", ""), (4, "a " * 5000, "", "", ""), (4, "a " * 5000, "", "", "")]
    got = pack_documents(spark.createDataFrame(rows, schema).coalesce(1), PATH, size=64).collect()
    assert {p.doc_id for p in got} == {1, 2, None, 4}
    assert sum(p.length for p in got if p.doc_id == 4) == 2 * next(p.doc_tokens for p in got if p.doc_id == 4)
    assert [np.frombuffer(p.ids, "<u4").tolist() for p in got if p.doc_id in (1, 2)] == [[0], [0]]
    assert pack_documents(spark.createDataFrame([], schema), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(2, 16), st.integers(1, 6))
def test_packer_keeps_every_id(lengths, size, max_open):
    packer, windows = SumOfSquaresPacker(size, max_open), []
    for doc_id, length in enumerate(lengths):
        windows += packer.place(doc_id, np.arange(length))
        assert packer.counts.sum() <= max_open + 1
    windows += packer.drain()
    seen = defaultdict(list)
    for w in windows:
        assert w.level == sum(len(p.ids) for p in w.pieces) <= size
        for p in w.pieces:
            assert p.ids.tolist() == list(range(p.start, p.start + len(p.ids)))
            seen[p.doc_id] += p.ids.tolist()
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(lengths)}
    assert sum(w.level < size for w in windows) <= 1


def test_packer_takes_the_level_with_the_smallest_sum_of_squares():
    packer = SumOfSquaresPacker(10)
    for length in (6, 6, 7):  # levels 6, 6 and 7; 6 + 3 = 9, 7 + 3 = 10, 3 = new
        packer.place(0, np.arange(length))
    before = packer.counts.copy()
    sums = {}
    for level, target in ((0, 3), (6, 9), (7, 10)):
        counts = before.copy()
        counts[level] -= level > 0
        counts[target] += 1
        sums[level] = int((counts[1:10] ** 2).sum())
    assert packer._best_level(3) == min(sums, key=lambda k: (sums[k], -k))


def test_query_reads_back_what_the_library_gives(spark, library):
    docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r.doc_id)
    want, start = [], 0
    for r in docs:
        ids = [*library(r.text), 2]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op2_token_files(spark, DATA).collect())) == want


def test_token_file_edge_cases(spark, tmp_path, library):
    schema = "doc_id long, text string, start string, path string"
    rows = [(5, None, "x", "p"), (None, "a", None, None), (3, "b c", "", ""), (3, "b c", "", ""), (1, "word " * 9000, "", "")]
    shards = write_token_files(spark.createDataFrame(rows, schema), str(tmp_path / "t"), PATH, length=16, batch=4)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(spark, shards).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 3, 3, 5]
    at = 0
    for doc_id, start, ids in got:
        text = {5: None, None: "a", 3: "b c", 1: "word " * 9000}[doc_id]
        assert (start, ids) == (at, [*library(text), 2])
        at += len(ids)
    empty = write_token_files(spark.createDataFrame([], schema), str(tmp_path / "e"), PATH)
    assert read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("total", [0, 1, 7, 8, 63, 64, 65, 200])
def test_random_access(tmp_path, total):
    values = np.arange(total).astype("<u2")
    path = str(tmp_path / "f.arrows")
    with pa.OSFile(path, "wb") as sink:
        writer = SequenceWriter(sink, values.dtype, 8, 4)
        for part in np.array_split(values, 7):
            writer.add(part.tobytes())
        writer.close()
    with pa.memory_map(path) as source:
        reader = SequenceReader(source)
        assert reader.tokens(0, total).tolist() == values.tolist()
        count = -(-total // 8)
        for i in reversed(range(count)):
            ids, mask = reader.sequence(i)
            assert ids[mask].tolist() == values[8 * i : 8 * i + 8].tolist() and len(ids) == 8
        with pytest.raises(IndexError):
            reader.sequence(count)
        assert sum(b.num_rows for b in pa.ipc.open_stream(pa.memory_map(path))) == count


def test_added_tokens_as_the_library_by_default():
    whole, encoder = Tokenizer.from_file(PATH), ChunkEncoder(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|><|endoftext|> y", "<|endoftext|", None, "plain words", "a\n<|endoftext|> \n b "]
    for text, packed in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(packed, encoder.dtype).tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_remembered_words_are_bounded_within_a_batch():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    texts = [" ".join(words), "x " + " ".join(f"{w}." for w in words), "even  blanks", "line \n  end ", "a　 b", None, ""]
    whole, encoder = Tokenizer.from_file(PATH), ChunkEncoder(PATH, most=50)
    got = [np.frombuffer(ids, encoder.dtype).tolist() for ids in encoder.encode(texts)]
    assert got == [whole.encode(text or "", add_special_tokens=False).ids for text in texts]
    assert len(encoder._words) <= 51
