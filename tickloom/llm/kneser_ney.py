"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import file_system, id_bitmaps, unused, with_membership
from tickloom.settings import materialize, scratch_path

BITS = 12
ALPHABET = 1 << BITS
SLICE_CHARS = 500_000
PART_BYTES = 4 << 20
HELD_GRAMS = 1_000_000


@dataclass(frozen=True)
class ModelSettings:
    """``order`` characters an n-gram, five at the most. Of the trusted documents, ``held_out_pct``
    percent train nothing; the ``quantile`` of their perplexity, times ``slack``, is the
    threshold of their language. Documents that are read together are scored together, in blocks
    that end at ``block_docs`` documents or ``block_bytes`` bytes of text.
    """

    order: int = 4
    held_out_pct: int = 10
    quantile: float = 0.99
    slack: float = 1.15
    block_docs: int = 16384
    block_bytes: int = 32 << 20


def gram_keys(texts: list[str], order: int, heads: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram that ends at each character of the texts, and the characters per text.

    A text is preceded by its head, the ``order - 1`` characters before it, or by as many padding
    symbols if that is empty. Characters from U+07FF on share 2,048 symbols.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = order - 1
    heads = heads or [""] * len(texts)
    joined = "".join(head.rjust(pad) + text for head, text in zip(heads, texts))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(points < 2047, points + 1, 2048 + points % 2048)
    begins = np.cumsum(lengths + pad) - lengths - pad
    first = np.fromiter((not head for head in heads), bool, len(heads))
    ahead = np.zeros(len(codes), bool)
    for step in range(pad):
        ahead[begins + step] = True
        codes[begins[first] + step] = 0
    keys = codes.copy()
    for step in range(1, order):
        keys[step:] |= codes[: len(codes) - step] << (BITS * step)
    return keys[~ahead], lengths


def runs(texts: list[str], order: int, most: int = SLICE_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`gram_keys` of about ``most`` characters at a time: which texts, n-grams, characters of each.

    A longer text is cut; its later parts know the characters before them.
    """
    held: list[tuple[int, int, int]] = []

    def keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heads = [texts[i][max(0, begin - order + 1) : begin] for i, begin, _ in held]
        found, lengths = gram_keys([texts[i][begin:end] for i, begin, end in held], order, heads)
        return np.array([i for i, _, _ in held], np.int64), found, lengths

    room = most
    for i, text in enumerate(texts):
        for begin in range(0, max(len(text), 1), most):
            end = min(begin + most, len(text))
            held.append((i, begin, end))
            room -= end - begin
            if room <= 0:
                yield keys()
                held, room = [], most
    if held:
        yield keys()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of n-grams with summed counts out of several."""
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


_STORED_DDL = "block long, lang string, gram long, n long, path string, begin long, size long"
_STORED = pa.schema(
    [
        ("block", pa.int64()), ("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64()),
        ("path", pa.string()), ("begin", pa.int64()), ("size", pa.int64()),
    ]
)


class _Block:
    """Texts of a block as a compressed Arrow stream, and its distinct n-grams per language."""

    def __init__(self, schema: pa.Schema, order: int):
        self._order, self.docs, self.bytes = order, 0, 0
        self._sink = pa.BufferOutputStream()
        self._stream = pa.ipc.new_stream(self._sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6)))
        self._found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self._held: dict[str, int] = {}

    def add(self, part: pa.RecordBatch) -> None:
        self._stream.write_batch(part)
        groups: dict[tuple[str, bool], list[str]] = {}
        for lang, train, text in zip(*(part.column(c).to_pylist() for c in ("lang", "train", "text"))):
            groups.setdefault((lang, train), []).append(text)
        for (lang, train), texts in groups.items():
            for _, keys, _ in runs(texts, self._order):
                self._count(lang, *np.unique(keys, return_counts=True), train)
        self.docs += part.num_rows
        self.bytes += part.nbytes

    def _count(self, lang: str, grams: np.ndarray, n: np.ndarray, train: bool) -> None:
        parts = self._found.setdefault(lang, [])
        parts.append((grams, n if train else n * 0))
        self._held[lang] = self._held.get(lang, 0) + len(grams)
        if self._held[lang] > max(HELD_GRAMS, 2 * len(parts[0][0])):
            self._found[lang] = [_merged(parts)]
            self._held[lang] = len(self._found[lang][0][0])

    def close(self) -> tuple[pa.Buffer, Iterator[tuple[str, np.ndarray, np.ndarray]]]:
        self._stream.close()
        return self._sink.getvalue(), ((lang, *_merged(parts)) for lang, parts in self._found.items())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``PART_BYTES`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def _store_blocks(batches: Iterator[pa.RecordBatch], folder: str, settings: ModelSettings) -> Iterator[pa.RecordBatch]:
    """One file of compressed blocks per attempt of a task; yields where they lie, and their n-grams.

    Only the rows of the attempt that Spark commits name a file, so retries are safe.
    """
    attempt, numbers = TaskContext.get().taskAttemptId(), itertools.count()
    files, base = file_system(folder)
    files.create_dir(base, recursive=True)
    path = f"{folder}/texts-{attempt:010d}"

    def rows(many: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(many, f.type) for f in _STORED]
        return pa.RecordBatch.from_arrays(arrays, schema=_STORED)

    with files.open_output_stream(f"{base}/texts-{attempt:010d}") as out:

        def stored(block: _Block) -> Iterator[pa.RecordBatch]:
            number, begin = (attempt << 24) + next(numbers), out.tell()
            data, counts = block.close()
            out.write(data)
            yield rows(1, block=[number], path=[path], begin=[begin], size=[data.size])
            for lang, grams, n in counts:
                names = pa.array([lang]).take(pa.array(np.zeros(len(grams), np.int32)))
                yield rows(len(grams), block=np.full(len(grams), number), lang=names, gram=grams, n=n)

        block = None
        for part in _parts(batches):
            block = block or _Block(part.schema, settings.order)
            for at in range(0, part.num_rows, settings.block_docs):
                piece = part.slice(at, settings.block_docs)
                if block.docs and (
                    block.docs + piece.num_rows > settings.block_docs or block.bytes + piece.nbytes > settings.block_bytes
                ):
                    yield from stored(block)
                    block = _Block(part.schema, settings.order)
                block.add(piece)
        if block:
            yield from stored(block)
    pa.default_memory_pool().release_unused()


def _discounted(counts: DataFrame) -> DataFrame:
    """Counts with the discounts of their language: columns ``n``, ``d1``, ``d2``, ``d3``, ``cut``."""
    n1, n2, n3, n4 = (F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))
    y = n1 / F.greatest(n1 + 2 * n2, F.lit(1))

    def discount(k: int, less: Column, more: Column) -> Column:
        value = F.when((less > 0) & (more > 0), k - (k + 1) * y * more / less)
        return F.greatest(F.lit(0.0), F.least(F.coalesce(value, F.lit(k / 2)), F.lit(float(k))))

    rates = counts.groupBy("lang").agg(
        discount(1, n1, n2).alias("d1"), discount(2, n2, n3).alias("d2"), discount(3, n3, n4).alias("d3")
    )
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # stored, so that Spark knows how small the table is and doesn't deal the counts out by language
    return counts.join(materialize(rates, "rates"), "lang").withColumn("cut", cut)


def _mixed(counts: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """``p`` of every (lang, gram) of ``counts`` from that of its suffix in ``lower``, or from equal symbols."""
    rows = _discounted(counts).withColumn("context", F.shiftright("gram", BITS))
    contexts = rows.filter("n > 0").groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
    if lower is None:
        rows = rows.withColumn("p", F.lit(1.0 / ALPHABET))
    else:
        rows = rows.withColumn("suffix", _suffix(order)).join(lower.withColumnRenamed("gram", "suffix"), ["lang", "suffix"])
    rows = rows.join(contexts, ["lang", "context"], "left")
    own = F.when(F.col("n") > 0, F.col("n") - F.col("cut")).otherwise(0.0)
    mixed = (own + F.col("freed") * F.col("p")) / F.col("total")
    return rows.select("lang", "gram", F.coalesce(mixed, F.col("p")).alias("p"))


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND((1 << (BITS * (order - 1))) - 1)


def _probabilities(counts: DataFrame, order: int) -> DataFrame:
    """``p`` of every (lang, gram) of this order, interpolated down to equal symbols.

    ``counts`` are n-gram counts at the highest order and numbers of distinct left neighbours
    below, 0 for what is only asked for. All tables are sharded by (lang, n-gram) and meet in
    joins. Each order is stored before the next one, so that no plan holds them all.
    """
    levels = [counts]
    for k in range(order, 1, -1):
        below = levels[0].groupBy("lang", _suffix(k).alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n"))
        levels.insert(0, materialize(below, "gram-counts"))
    known = None
    for k, level in enumerate(levels, 1):
        known = _mixed(level, known, k)
        known = known if k == order else materialize(known, "probabilities")
    return known


_SCORE_DDL = "doc_id long, lang string, row_hash long, trusted boolean, held_out boolean, n_chars long, perplexity double"
_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()), ("lang", pa.string()), ("row_hash", pa.int64()), ("trusted", pa.bool_()),
        ("held_out", pa.bool_()), ("n_chars", pa.int64()), ("perplexity", pa.float64()),
    ]
)


def _score_part(rows: pa.RecordBatch, models: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> pa.RecordBatch:
    texts, spoken = rows.column("text").to_pylist(), np.array(rows.column("lang").to_pylist(), object)
    lengths, sums = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
    for lang in set(spoken):
        at = np.flatnonzero(spoken == lang)
        if lang in models:
            sums[at] = 0.0
        for which, keys, n in runs([texts[i] for i in at], order):
            np.add.at(lengths, at[which], n)
            if lang in models and len(keys):
                known, log = models[lang]
                total = np.concatenate([[0.0], np.cumsum(log[np.searchsorted(known, keys)])])
                ends = np.cumsum(n)
                np.add.at(sums, at[which], total[ends] - total[ends - n])
    with np.errstate(invalid="ignore", divide="ignore"):
        means = np.where(lengths > 0, sums / lengths, np.nan)
    perplexity = pa.array(np.exp(-means), mask=np.isnan(means))
    columns = [rows.column(c) for c in ("doc_id", "lang", "row_hash", "trusted", "held_out")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(lengths), perplexity], schema=_SCORES)


def _score_block(places: pa.Table, answers: pa.Table, order: int) -> pa.Table:
    """Perplexity of the documents of a block from the probabilities of its n-grams."""
    models: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    langs = answers["lang"].combine_chunks().dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    grams, logs = answers["gram"].to_numpy(), np.log(answers["p"].to_numpy())
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        keys, first = np.unique(grams[codes == code], return_index=True)
        models[lang] = (keys, logs[codes == code][first])
    out = []
    for path, begin, size in zip(*(places[c].to_pylist() for c in ("path", "begin", "size"))):
        files, name = file_system(path)
        with files.open_input_file(name) as source:
            source.seek(begin)
            out += [_score_part(rows, models, order) for rows in pa.ipc.open_stream(source.read_buffer(size))]
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(out, schema=_SCORES)


def _prepared(
    docs: DataFrame, labels: DataFrame, settings: ModelSettings, id_col: str, text_col: str, lang_col: str
) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = with_membership(rows, "doc_id", id_bitmaps(good, "doc_id"), "trusted")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(100))
    train = F.col("trusted") & (fold >= settings.held_out_pct)
    return rows.select(
        "doc_id",
        "lang",
        F.xxhash64("doc_id", "lang", "text", F.col("doc_id").isNull()).alias("row_hash"),
        "trusted",
        (F.col("trusted") & (fold < settings.held_out_pct)).alias("held_out"),
        F.coalesce(train, F.lit(False)).alias("train"),
        "text",
    )


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    settings: ModelSettings = ModelSettings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, ``n_chars``, ``perplexity``, ``threshold``, ``kept``.

    Trusted are the documents that ``labels`` (doc_id, quality) gives quality 1. Each language has
    a model of its own, counted over all its trusted documents but the held-out ones. Texts are
    read once, and kept compressed in the shared folder in blocks of bounded size. The distinct
    n-grams of a block ask the sharded model tables for their probabilities; the task that gets
    the answers reads the block. Blocks don't change the scores.

    A null text is empty and has no perplexity; it isn't kept. A null language is the empty one.
    A language without trusted text has no perplexity, or no threshold, and all its texts are
    kept. Null ids are never trusted. Repeated rows are scored each. Other columns are dropped.
    """
    rows = _prepared(docs, labels, settings, id_col, text_col, lang_col)
    store = partial(_store_blocks, folder=scratch_path(docs.sparkSession, "texts"), settings=settings)
    stored = materialize(rows.mapInArrow(store, _STORED_DDL), "grams")
    grams = stored.filter("path is null").select("block", "lang", "gram", "n")
    places = stored.filter("path is not null").select(F.col("block").alias("at_block"), "path", "begin", "size")
    totals = materialize(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    probabilities = _probabilities(totals, settings.order)
    trained = materialize(totals.filter("n > 0").select("lang").distinct(), "trained")
    known = materialize(probabilities.join(trained, "lang", "left_semi"), "probabilities")
    answers = grams.select("block", "lang", "gram").join(known, ["lang", "gram"])
    scored = (
        places.groupBy("at_block")
        .cogroup(answers.select("block", "lang", "gram", "p").groupBy("block"))
        .applyInArrow(partial(_score_block, order=settings.order), _SCORE_DDL)
    )
    scores = materialize(scored, "scores")
    limits = scores.filter(F.col("held_out") & F.col("perplexity").isNotNull()).groupBy("lang").agg(
        (F.percentile_approx("perplexity", settings.quantile, 10_000) * settings.slack).alias("threshold")
    )
    fine = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & (F.col("n_chars") > 0)
    return scores.join(materialize(limits, "limits"), "lang", "left").select(
        "doc_id", "lang", "n_chars", "perplexity", "threshold", fine.alias("kept"), "row_hash"
    )


def keep_fluent(
    docs: DataFrame,
    labels: DataFrame,
    settings: ModelSettings = ModelSettings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``docs`` without those that :func:`score_documents` does not keep; all columns stay.

    An id goes if none of its rows is kept. Rows with a null id go one by one.
    """
    scores = score_documents(docs, labels, settings, id_col, text_col, lang_col)
    judged = materialize(scores.select("doc_id", "row_hash", "kept"), "judged")
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter(~F.col("kept"))
    name = unused(docs, "is_gone")
    known = with_membership(docs.filter(F.col(id_col).isNotNull()), id_col, id_bitmaps(gone, "doc_id"), name)
    nameless = judged.filter(F.col("doc_id").isNull() & ~F.col("kept")).select(F.col("row_hash").alias(name)).distinct()
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.xxhash64(F.col(id_col).cast("long"), lang, text, F.col(id_col).isNull())
    rest = docs.filter(F.col(id_col).isNull()).withColumn(name, hashed).join(nameless, name, "left_anti")
    return known.filter(~F.col(name)).select(*docs.columns).unionByName(rest.select(*docs.columns))
