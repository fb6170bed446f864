"""Benchmark decontamination with a positional inverted index of the training documents.

The index is cut by documents into blocks of about equal size, and each block by
terms into shards, so a term with a third of all words is a short list in each of many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.settings import materialize

# Lower-cases A-Z, keeps 0-9, a-z and all bytes of other characters, and blanks out the rest.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_INDEX = pa.schema(
    [
        ("block", pa.int64()), ("shard", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary()),
        ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int64())),
    ]
)
_INDEX_DDL = "block long, shard int, terms binary, counts binary, postings binary, doc_ids array<long>, doc_words array<long>"
_PHRASES_DDL = "item_id string, phrase binary, words array<binary>, shards array<int>"
_LISTS_DDL = "block long, term binary, n long, postings binary"
_DOCS_DDL = "doc_id long, n_words long, n_hit long, phrases array<long>"
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("phrases", pa.list_(pa.int64()))])
# Places over which documents with the same windows are spread.
_COPIES = 8
_NEAR_DDL = "item_id string, doc_id long, begin long, length long"


@dataclass(frozen=True)
class IndexSettings:
    """``block_bytes`` bytes of text a block (a longer text is a block by itself), terms in ``shards`` rows a block."""

    block_bytes: int = 1 << 22
    shards: int = 32


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; none for a null text."""
    return [] if text is None else text.translate(_WORD_BYTES).split()


def word_array(texts: list[bytes | None]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Words of all texts in a row, each with a blank behind it, and their number per text."""
    joined = b" ".join(text or b"" for text in [*texts, b""])
    data = np.frombuffer(joined.translate(_WORD_BYTES), np.uint8)
    inside = data != 32
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    text_ends = np.cumsum(np.fromiter((len(text or b"") + 1 for text in texts), np.int64, len(texts)))
    sizes = np.diff(np.searchsorted(begins, text_ends), prepend=0)
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    ends = np.cumsum(kept)[begins] - 1
    offsets = np.append(ends, np.count_nonzero(kept))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), buffers), sizes


def _layout(terms: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all terms, and where each begins, with the end."""
    offsets = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    return np.frombuffer(terms.buffers()[2] or b"", np.uint8), offsets


def shards_of(terms: pa.LargeBinaryArray, shards: int) -> np.ndarray:
    """Shard of every term, by a sum of its bytes weighted by place."""
    data, offsets = _layout(terms)
    if not len(terms):
        return np.zeros(0, np.int64)
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    weighted = data[offsets[0] : offsets[-1]] * ((place + 1) * 2654435761 % (1 << 32))
    sums = np.add.reduceat(weighted, offsets[:-1] - offsets[0])
    return (sums % (1 << 32) >> 12) % shards


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes, seven bits a byte and low bits first, and each one's end."""
    sizes, most = np.ones(len(values), np.int64), int(values.max(initial=0))
    for bits in range(7, most.bit_length(), 7):
        sizes += values >= 1 << bits
    ends = np.cumsum(sizes)
    packed = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for step in range(sizes.max(initial=0)):
        longer = np.flatnonzero(sizes > step) if step else slice(None)
        low = (values[longer] >> (7 * step)) & 127
        packed[ends[longer] - sizes[longer] + step] = low | ((sizes[longer] > step + 1) << 7)
    return packed, ends


def unpack(packed: bytes) -> np.ndarray:
    """The numbers of ``pack``."""
    data = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    sizes = ends - begins + 1
    values = np.zeros(len(ends), np.int64)
    for step in range(sizes.max(initial=0)):
        longer = np.flatnonzero(sizes > step)
        values[longer] |= (data[begins[longer] + step].astype(np.int64) & 127) << (7 * step)
    return values


def positions_of(postings: bytes) -> np.ndarray:
    return np.cumsum(unpack(postings))


def _doc_starts(doc_words: np.ndarray) -> np.ndarray:
    """First position of each document; one position between two documents stays empty."""
    return np.cumsum(doc_words + 1) - doc_words - 1


def _by_code(codes: np.ndarray) -> np.ndarray:
    """Stable order of non-negative codes below 2^32, by their low and then their high halves."""
    order = np.argsort(codes.astype(np.uint16), kind="stable")
    return order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]


def _block_rows(block: int, ids: list, texts: list[bytes | None], shards: int) -> pa.RecordBatch:
    """One row of documents and one row per shard with the posting lists of its terms."""
    words, sizes = word_array(texts)
    rows = [(block, -1, None, None, None, ids, sizes.tolist())]
    if len(words):
        coded = words.dictionary_encode()
        shard = shards_of(coded.dictionary, shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[coded.indices.to_numpy()]
        by_term = _by_code(codes)
        positions = (np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes))[by_term]
        first = np.flatnonzero(np.diff(codes[by_term], prepend=-1))
        steps = np.diff(positions, prepend=0)
        steps[first] = positions[first]
        packed, ends = pack(steps)
        counts, count_ends = pack(np.diff(first, append=len(codes)))
        names, name_bounds = _layout(coded.dictionary.take(pa.array(order)))
        # Where the lists and counts of each term begin, with the end.
        list_bounds = np.append((ends - np.diff(ends, prepend=0))[first], len(packed))
        count_bounds = np.concatenate([[0], count_ends])
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(bounds)):
            pieces = ((names, name_bounds), (counts, count_bounds), (packed, list_bounds))
            rows.append((block, s, *(d[b[bounds[s]] : b[bounds[s + 1]]].tobytes() for d, b in pieces), None, None))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)


def _index(batches: Iterator[pa.RecordBatch], settings: IndexSettings) -> Iterator[pa.RecordBatch]:
    # Block numbers depend on the task alone, so a repeated task gives the same ones.
    block = TaskContext.get().partitionId() << 32
    ids, texts, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                size = len(text or b"")
                if ids and held + size > settings.block_bytes:
                    yield _block_rows(block, ids, texts, settings.shards)
                    block, ids, texts, held = block + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += size
    if ids:
        yield _block_rows(block, ids, texts, settings.shards)


def build_index(
    docs: DataFrame, settings: IndexSettings = IndexSettings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Positional inverted index of all words of the documents, stored in the shared folder.

    A block has a row of shard -1 with ``doc_ids`` and ``doc_words``, and a row per shard with its
    ``terms`` (a blank behind each), their ``counts``, and ``postings``: gaps between positions in the
    block. Null and empty texts have no words. Null ids and repeated rows are documents of their
    own. Documents aren't shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return materialize(rows.mapInArrow(partial(_index, settings=settings), _INDEX_DDL), "phrase-index")


def _cut_items(batches: Iterator[pa.RecordBatch], width: int, shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            size = min(width, len(words)) if width else len(words)
            runs = {b" ".join(run): run for run in (words[i : i + size] for i in range(len(words) - size + 1)) if run}
            if runs:
                known = dict(zip(words, shards_of(pa.array([w + b" " for w in words], pa.large_binary()), shards).tolist()))
                numbers = [[known[w] for w in run] for run in runs.values()]
                columns = ([item] * len(runs), list(runs), list(runs.values()), numbers)
                types = (pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                names = ["item_id", "phrase", "words", "shards"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def item_phrases(items: DataFrame, settings: IndexSettings, width: int | None, id_col: str, text_col: str) -> DataFrame:
    """Distinct runs of ``width`` words of every item, or its whole sequence if shorter or without ``width``."""
    rows = items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(partial(_cut_items, width=width or 0, shards=settings.shards), _PHRASES_DDL)


def _find_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, names, counts, packed, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            at = pc.index_in(pa.array(wanted, pa.binary()), pa.array(names.split(), pa.binary()))
            places = at.drop_null().to_numpy()
            n = unpack(counts)
            stops = np.flatnonzero(np.frombuffer(packed, np.uint8) < 128)[np.cumsum(n) - 1] + 1
            begins = np.concatenate([[0], stops[:-1]])
            lists = [packed[begins[p] : stops[p]] for p in places]
            terms = pc.filter(pa.array(wanted, pa.binary()), at.is_valid())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(lists), pa.int64()), terms, pa.array(n[places]), pa.array(lists, pa.binary())],
                names=["block", "term", "n", "postings"],
            )


def posting_lists(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``block``, ``term``, ``n`` and ``postings`` of the wanted (``shard``, ``term``) rows, stored.

    The wanted terms meet the index by shard, one row a shard.
    """
    by_shard = wanted.groupBy("shard").agg(F.collect_set("term").alias("wanted"))
    rows = index.filter("shard >= 0").join(by_shard, "shard").select("block", "terms", "counts", "postings", "wanted")
    return materialize(rows.mapInArrow(_find_lists, _LISTS_DDL), "posting-lists")


def _terms(phrases: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.col("words").alias("term"), F.col("shards").alias("shard"))
    return phrases.select("phrase_id", F.posexplode(pairs).alias("place", "pair")).select("phrase_id", "place", "pair.term", "pair.shard")


def ranked_terms(phrases: DataFrame, lists: DataFrame) -> DataFrame:
    """``phrase_id`` and ``ranked``, its (total, term, place) from the rarest term; not for phrases with an unknown term."""
    totals = lists.groupBy("term").agg(F.sum("n").alias("total"))
    known = _terms(phrases).join(totals, "term").groupBy("phrase_id")
    ranked = known.agg(F.sort_array(F.collect_list(F.struct("total", "term", "place"))).alias("ranked"))
    whole = phrases.select("phrase_id", F.size("words").alias("size"))
    return ranked.join(whole, "phrase_id").filter(F.size("ranked") == F.col("size")).drop("size")


def _meets(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which ``values`` are among the sorted ones."""
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of the rarest term that have the second rarest at the right distance."""
    for batch in batches:
        kept, places = [], []
        for row, (left, right, gap) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("left", "right", "gap")))):
            at = positions_of(left)
            at = at[_meets(positions_of(right), at + gap)] if right is not None else at
            if len(at):
                kept.append(row)
                places.append(pack(np.diff(at, prepend=0))[0].tobytes())
        rows = batch.select(["block", "probe"]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(places, pa.binary())], names=["block", "probe", "places"])


def _alive(ranked: DataFrame, lists: DataFrame) -> DataFrame:
    """``block``, ``phrase_id``, ``ranked`` and the ``places`` of the rarest term, where the two rarest terms agree.

    Phrases with the same two terms at the same distance ask once.
    """
    first, second = F.col("ranked")[0], F.get("ranked", F.lit(1))
    probe = F.struct(first["term"].alias("term"), second["term"].alias("other"), (second["place"] - first["place"]).alias("gap"))
    probed = ranked.select("phrase_id", "ranked", probe.alias("probe"))
    left = lists.select("block", "term", F.col("postings").alias("left"))
    right = lists.select("block", F.col("term").alias("other"), F.col("postings").alias("right"))
    asked = probed.select("probe", "probe.*").distinct().join(left, "term").join(right, ["block", "other"], "left")
    asked = asked.filter(F.col("other").isNull() | F.col("right").isNotNull()).select("block", "probe", "left", "right", "gap")
    schema = asked.select("block", "probe", F.col("left").alias("places")).schema
    return asked.mapInArrow(_intersect, schema).join(probed, "probe").select("block", "phrase_id", "ranked", "places")


def _block_hits(lists: pa.Table, alive: pa.Table) -> pa.Table:
    """Every document of a block with its hit words and the phrases found in it."""
    at = lists.column("doc_ids").is_valid().to_numpy()
    docs = lists.filter(pa.array(at))
    ids, sizes = docs.column("doc_ids")[0].as_py(), np.array(docs.column("doc_words")[0].as_py(), np.int64)
    starts = _doc_starts(sizes)
    packed = dict(zip(lists.column("term").to_pylist(), lists.column("postings").to_pylist()))
    known: dict[bytes, np.ndarray] = {}
    # Phrases beginning minus phrases ended before each position.
    change = np.zeros(sizes.sum() + len(sizes) + 1, np.int32)
    doc_of, phrase_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for phrase, ranked, places in zip(*(alive.column(c).to_pylist() for c in ("phrase_id", "ranked", "places"))):
        begins = positions_of(places) - ranked[0]["place"]
        for entry in ranked[2:]:
            term = entry["term"]
            if term not in known:
                known[term] = positions_of(packed[term]) if term in packed else np.zeros(0, np.int64)
            begins = begins[_meets(known[term], begins + entry["place"])] if len(known[term]) else begins[:0]
            if not len(begins):
                break
        np.add.at(change, begins, 1)
        np.add.at(change, begins + len(ranked), -1)
        found = np.unique(np.searchsorted(starts, begins, side="right") - 1)
        doc_of.append(found)
        phrase_of.append(np.full(len(found), phrase))
    hit = np.flatnonzero(np.cumsum(change) > 0)
    n_hit = np.bincount(np.searchsorted(starts, hit, side="right") - 1, minlength=len(ids))
    doc_of, phrase_of = np.concatenate(doc_of), np.concatenate(phrase_of)
    order = np.lexsort((phrase_of, doc_of))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc_of, minlength=len(ids)))])
    phrases = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(phrase_of[order]))
    columns = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(n_hit.astype(np.int64)), phrases]
    return pa.Table.from_arrays(columns, schema=_DOCS)


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit`` and the ``phrases`` (ids) found in it, of every indexed document.

    Posting lists are intersected from the rarest terms on: the two rarest in joins by (block,
    term), the others only where those agree, all terms of a block in one task. A block is of
    limited size, so this holds for hot terms and hot passages too.
    """
    lists = posting_lists(index, _terms(phrases).select("shard", "term").distinct())
    ranked = materialize(ranked_terms(phrases, lists), "ranked-phrases")
    alive = materialize(_alive(ranked, lists), "alive-phrases")
    blocks = alive.select("block").distinct()
    needed = ranked.join(alive.select("phrase_id").distinct(), "phrase_id", "left_semi")
    needed = needed.select(F.explode(F.slice("ranked", 3, 1 << 20)).alias("entry")).select("entry.term").distinct()
    further = lists.join(needed, "term", "left_semi").join(blocks, "block", "left_semi").select("block", "term", "postings")
    docs = index.filter("shard = -1").select("block", "doc_ids", "doc_words")
    left = docs.unionByName(further, allowMissingColumns=True)
    return left.groupBy("block").cogroup(alive.groupBy("block")).applyInArrow(_block_hits, _DOCS_DDL)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    settings: IndexSettings = IndexSettings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of every document.

    A window is a run of ``width`` words of an item, or all of a shorter one; words of a document
    inside any occurrence of a window are hit. Windows that several items share are searched
    once, and documents with the same windows share one digest of their items' ids. Null and
    empty texts have no words. Repeated rows and null ids of documents are documents of their own.
    Items of one id are one item; words of an item without id count as hit but it is no item.
    Without items nothing is hit; without documents the result is empty. Other columns are dropped.
    """
    index = build_index(docs, settings, id_col, text_col)
    cut = materialize(item_phrases(items, settings, width, item_col, item_text_col), "item-phrases")
    phrases = cut.dropDuplicates(["phrase"]).drop("item_id").withColumn("phrase_id", F.monotonically_increasing_id())
    phrases = materialize(phrases, "phrases")
    found = materialize(phrase_hits(index, phrases.drop("phrase")), "phrase-hits")
    members = cut.select("item_id", "phrase").join(phrases.select("phrase", "phrase_id"), "phrase").select("item_id", "phrase_id")
    sets = found.filter(F.size("phrases") > 0).select("phrases").distinct()
    listed = sets.select("phrases", F.explode("phrases").alias("phrase_id")).join(members, "phrase_id")
    listed = listed.filter("item_id IS NOT NULL").select("phrases", "item_id").distinct()
    digests = listed.groupBy("phrases").agg(
        F.count("*").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ",").cast("binary"), 256).alias("items_sha256"),
    )
    # Clean documents need no digest; copies of one document ask for theirs in several partitions.
    copies = digests.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(_COPIES - 1))))
    hit = found.filter("n_hit > 0").withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.lit(_COPIES)).cast("int"))
    hit = hit.join(copies, ["phrases", "copy"], "left").drop("copy")
    return hit.unionByName(found.filter("n_hit = 0"), allowMissingColumns=True).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _spans(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Shortest stretches that hold all terms of an item within one document."""
    for batch in batches:
        for item, lists, ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            sizes = np.array(sizes, np.int64)
            starts = _doc_starts(sizes)
            places = [positions_of(p) for p in lists]
            begins = np.unique(np.concatenate(places))
            last = begins.copy()
            for p in places:
                following = np.append(p, np.iinfo(np.int64).max)[np.searchsorted(p, begins)]
                last = np.maximum(last, following)
            doc = np.searchsorted(starts, begins, side="right") - 1
            good = (last - begins < span) & (last < starts[doc] + sizes[doc])
            begins, last, doc = begins[good], last[good], doc[good]
            # Of the stretches with one end, the shortest.
            least = np.append(last[1:] != last[:-1], True)[: len(last)]
            begins, last, doc = begins[least], last[least], doc[least]
            columns = ([item] * len(doc), [ids[d] for d in doc], begins - starts[doc], last - begins + 1)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["item_id", "doc_id", "begin", "length"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def proximity_matches(
    index: DataFrame,
    items: DataFrame,
    terms: int = 5,
    span: int = 20,
    settings: IndexSettings = IndexSettings(),
    id_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """Where the ``terms`` rarest different words of an item stand within ``span`` words of one document, in any order.

    Returns ``item_id``, ``doc_id``, ``begin`` (0-based word) and ``length`` of every shortest stretch.
    Items with a word the index doesn't know use their other words; those without a known word match
    nothing. Items of one text under several ids are found for each; repeated rows of documents
    match each for itself.
    """
    whole = materialize(item_phrases(items, settings, None, id_col, text_col), "items")
    phrases = whole.select("item_id", F.array_distinct(F.arrays_zip("words", "shards")).alias("pairs"))
    phrases = phrases.select("item_id", F.explode("pairs").alias("pair")).distinct()
    phrases = phrases.select("item_id", F.col("pair.words").alias("term"), F.col("pair.shards").alias("shard"))
    lists = posting_lists(index, phrases.select("shard", "term").distinct())
    totals = lists.groupBy("term").agg(F.sum("n").alias("total"))
    known = phrases.join(totals, "term").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("total", "term"))).alias("ranked"))
    picked = known.select("item_id", F.slice("ranked", 1, terms).alias("ranked"))
    picked = picked.select("item_id", F.size("ranked").alias("size"), F.explode("ranked.term").alias("term"))
    met = lists.join(picked, "term").groupBy("block", "item_id").agg(
        F.collect_list("postings").alias("lists"), F.max("size").alias("size")
    )
    met = met.filter(F.size("lists") == F.col("size"))
    docs = index.filter("shard = -1").select("block", "doc_ids", "doc_words")
    return met.join(docs, "block").select("item_id", "lists", "doc_ids", "doc_words").mapInArrow(partial(_spans, span=span), _NEAR_DDL)
