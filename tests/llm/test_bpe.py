"""Prefix-table BPE against tiktoken and against plain merging."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.bpe import Encoder, PrefixTable, Ranks, decode_documents, encode_documents
from tickloom.llm.queries import op9_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DATA = "/root/testdata/sf0.001"
RANKS = Ranks(PATH)
ENCODER = Encoder(PATH, public_tokenizers.PATTERN, most=200)
with open(PATH, "rb") as lines:
    LIBRARY = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)},
        special_tokens={},
    )


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x1f\x85\xa0 　a'stBé9!,日<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_are_those_of_tiktoken(text):
    assert np.frombuffer(ENCODER.encode([text])[0], np.int32).tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60) | st.text("aein thoérs", max_size=60).map(str.encode))
def test_table_is_plain_merging(data):
    table = PrefixTable(RANKS, data)
    assert table.tokens() == RANKS.merged(data)
    for end in range(1, len(data) + 1):
        assert table.last[end - 1] == RANKS.merged(data[:end])[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("aeinthoérs", max_size=80).map(str.encode), st.text("aeinthoé", max_size=12).map(str.encode), st.data())
def test_appends_and_edits_are_exact(data, new, draw):
    table = PrefixTable(RANKS, data)
    table.append(new)
    assert table.tokens() == RANKS.merged(data + new)
    whole = bytes(table.data)
    begin = draw.draw(st.integers(0, len(whole)))
    end = draw.draw(st.integers(begin, len(whole)))
    table.splice(begin, end, new)
    edited = whole[:begin] + new + whole[end:]
    assert (bytes(table.data), table.tokens()) == (edited, RANKS.merged(edited))


def test_pairs_are_tested_without_merging_their_bytes(monkeypatch):
    ranks, random_ = Ranks(PATH), random.Random(2)
    words = [LIBRARY.encode_ordinary("".join(random_.choices("aeinthoérs", k=12))) for _ in range(1000)]
    pairs = [pair for ids in words for pair in zip(ids, ids[1:])]
    pairs += [tuple(random_.choices(list(ranks.bytes_of), k=2)) for _ in range(1000)]
    for left, right in list(pairs):
        data = ranks.bytes_of[left] + ranks.bytes_of[right]
        cuts = [(ranks.ids.get(data[:i]), ranks.ids.get(data[i:])) for i in range(1, len(data))]
        pairs += [cut for cut in cuts if None not in cut]
    want = [RANKS.merged(ranks.bytes_of[a] + ranks.bytes_of[b]) == [a, b] for a, b in pairs]
    merged, plain = [], Ranks.merged
    monkeypatch.setattr(Ranks, "merged", lambda self, data, *upto: merged.append(data) or plain(self, data, *upto))
    assert [ranks.fits(a, b) for a, b in pairs] == want
    assert all(data in ranks.ids for data in merged)


def test_edit_near_the_start_leaves_the_rest_alone():
    data = "".join(random.Random(1).choices("aeinthors", k=4000)).encode()
    table = PrefixTable(RANKS, data)
    assert table.splice(5, 6, b"q") < 40 * RANKS.longest
    assert table.last == PrefixTable(RANKS, data[:5] + b"q" + data[6:]).last


def test_query_equals_tiktoken_and_round_trips(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = []
    for r in docs:
        ids = LIBRARY.encode_ordinary(r.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((r.doc_id, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, op9_byte_bpe(spark, DATA).collect())) == sorted(want)


def test_edge_cases(spark):
    schema = "doc_id long, text string, ids string, decoded string"
    rows = [(1, None, "x", "y"), (2, "", None, None), (None, "a b", "", ""), (4, "z" * 3000, "", ""), (4, "z" * 3000, "", "")]
    encoded = encode_documents(spark.createDataFrame(rows, schema), PATH, public_tokenizers.PATTERN)
    got = decode_documents(encoded, PATH).collect()
    assert sorted(((r.doc_id or 0), bytes(r.decoded).decode()) for r in got) == sorted(((i or 0), t or "") for i, t, *_ in rows)
    assert all(list(r.ids) == LIBRARY.encode_ordinary(bytes(r.decoded).decode()) for r in got)
    assert encode_documents(spark.createDataFrame([], schema), PATH, public_tokenizers.PATTERN).count() == 0
    nothing = decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()
    assert [r.decoded for r in nothing] == [None]
    with pytest.raises(Exception, match="KeyError"):
        decode_documents(spark.createDataFrame([(1, [10**8])], "doc_id long, ids array<int>"), PATH).collect()
