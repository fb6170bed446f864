"""Line de-duplication by an exact set-similarity join, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import id_bitmaps, unused, with_membership
from tickloom.settings import materialize, materialize_last

CELLS = 1 << 16
LOW_BITS = 48
# Tokens that two sets must share within their prefixes.
SHARED = 3
BLANKS = "\t\x0b\f\r"


def _words(line: Column) -> Column:
    lower = F.lower(line)
    spaced = F.when(reduce(or_, (F.contains(line, F.lit(c)) for c in BLANKS)), F.translate(lower, BLANKS, " " * len(BLANKS)))
    return F.array_remove(F.split(spaced.otherwise(lower), " "), "")


def _tokens(words: Column) -> Column:
    """Distinct 64-bit hashes of the pairs of neighbouring words."""
    count = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, 1, count), F.slice(words, 2, count), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(pairs)


def _row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull())


def _sets(lines: Column, min_words: int, order: Callable[[Column], Column]) -> Column:
    """Token set of each line of an array, null for one with too few words."""
    return F.transform(F.transform(lines, _words), lambda words: F.when(F.size(words) >= min_words, order(_tokens(words))))


def _lines(docs: DataFrame, min_words: int, order: Callable[[Column], Column] = lambda tokens: tokens) -> DataFrame:
    """(doc_id, row, line_no, tokens) of the lines with enough words.

    A generator makes the token sets, so that Spark evaluates them once and not again in filters.
    """
    sets = F.posexplode_outer(_sets(F.split("text", "\n"), min_words, order)).alias("line_no", "tokens")
    return docs.select("doc_id", "row", sets).filter(F.col("tokens").isNotNull())


def _cell(token: Column) -> Column:
    return F.shiftrightunsigned(token, LOW_BITS)


def _by_rarity(lines: DataFrame) -> Callable[[Column], Column]:
    """Renames tokens so that their order as numbers is that of rarity, and sorts them.

    The upper 16 bits of a hash are its cell. Cells are ranked by how many tokens of all lines
    fall into them, and the rank replaces them: names stay unique, and the table of ranks has the
    same size for every input.
    """
    counted = lines.select(F.explode_outer("tokens").alias("token")).groupBy(_cell(F.col("token")).alias("cell")).count()
    counts = {r["cell"]: r["count"] for r in counted.collect()}
    changes = [0] * CELLS
    for rank, cell in enumerate(sorted(range(CELLS), key=lambda c: (counts.get(c, 0), c))):
        changes[cell] = ((rank - CELLS // 2) ^ cell) << LOW_BITS
    changes = [(c + (1 << 63)) % (1 << 64) - (1 << 63) for c in changes]
    table = F.split(F.lit(",".join(map(str, changes))), ",").cast("array<long>")
    # never null, so that the arrays are sorted as plain numbers
    change = lambda t: F.coalesce(F.get(table, _cell(t)), F.lit(0).cast("long"))
    return lambda tokens: F.sort_array(F.transform(tokens, lambda t: t.bitwiseXOR(change(t))))


def _ceil_of(numerator: Column, denominator: int) -> Column:
    return F.floor((numerator + (denominator - 1)) / denominator).cast("int")


def _described(ordered: DataFrame, percent: int) -> DataFrame:
    """Every line's place, key (two hashes of its token set), size, prefix and parity bits."""
    size = F.size("tokens")
    one = F.lit(1).cast("long")
    parity = F.aggregate(
        "tokens",
        F.lit(0).cast("long"),
        lambda bits, t: bits.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(63).cast("int"))),
    )
    return ordered.select(
        F.struct("doc_id", "row", "line_no").alias("place"),
        F.xxhash64("tokens").alias("key"),
        F.xxhash64(F.lit(1), "tokens").alias("key2"),
        size.alias("n"),
        F.slice("tokens", 1, size - _ceil_of(size * percent, 100) + SHARED).alias("prefix"),
        parity.alias("parity"),
    )


def _classes(described: DataFrame) -> DataFrame:
    """Lines with equal token sets as one row: id, key, first place, number of lines, size, prefix,
    parity bits.
    """
    grouped = described.groupBy("key", "key2").agg(
        F.min("place").alias("place"),
        F.count("*").alias("lines"),
        *(F.first(c).alias(c) for c in ("n", "prefix", "parity")),
    )
    return grouped.withColumn("id", F.monotonically_increasing_id())


def _first_doc() -> Column:
    """Document of a class's first line, as a number that orders classes of different documents."""
    return F.coalesce("place.doc_id", F.lit(-(1 << 63))).alias("doc")


def _hub_pairs(classes: DataFrame) -> DataFrame:
    """Every class with the earliest one under each of four of its prefix tokens.

    The four are the first and last two by the bits below the cell, which are the same for most
    members of a group of near copies. There are at most four pairs a class, however many meet.
    """
    below = F.transform("prefix", lambda t: F.coalesce(F.call_function("shiftleft", t, F.lit(64 - LOW_BITS)), F.lit(0).cast("long")))
    mixed = classes.select("id", _first_doc(), F.sort_array(below).alias("mixed"))
    few = F.array_distinct(F.concat(F.slice("mixed", 1, 2), F.slice("mixed", F.greatest(F.size("mixed") - 1, F.lit(1)), F.lit(2))))
    rows = mixed.select("id", "doc", F.explode(few).alias("token"))
    hubs = rows.groupBy("token").agg(F.min_by("id", "doc").alias("hub"), F.count("*").alias("times")).filter("times > 1")
    met = rows.join(hubs.select("token", "hub"), "token").filter(F.col("id") != F.col("hub"))
    return met.select(F.col("hub").alias("id_a"), F.col("id").alias("id_b")).distinct()


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that pass prefix, position and length filters.

    Classes may have a column ``done``; pairs of which the later one is done are left out, unless
    both are of one document and one of them isn't.

    Two sets that must share ``needed`` tokens share the first ``SHARED`` of them, or all if these
    are fewer, within prefixes longer by as many, less one, than for a single shared token. A
    shorter line needs only the part of its prefix that lines as long as itself or longer can
    match. ``rest`` is how many tokens may still be shared from a place on.
    """
    done = F.col("done") if "done" in classes.columns else F.lit(False)
    rows = classes.select("id", "n", done.alias("done"), _first_doc(), F.posexplode("prefix").alias("at", "token"))
    short, long = (rows.select(*(F.col(c).alias(f"{c}_{side}") for c in rows.columns)) for side in "ab")
    total = F.col("n_a") + F.col("n_b")
    needed = _ceil_of(total * percent, 100 + percent)
    indexed = F.col("n_a") - _ceil_of(F.col("n_a") * 2 * percent, 100 + percent) + SHARED
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    both = (
        (F.col("token_a") == F.col("token_b"))
        & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b"))))
        & (F.col("n_b") * percent <= F.col("n_a") * 100)
        & ~((F.col("done_a") | (F.col("doc_a") < F.col("doc_b"))) & (F.col("done_b") | (F.col("doc_b") < F.col("doc_a"))))
        # said of both sides at once, so that either side stays the same shuffle
        & (F.col("at_a") < indexed + F.least(F.col("at_b"), F.lit(0)))
        & (rest + F.least("at_a", "at_b") >= needed)
    )
    weight = F.when(needed >= SHARED, 1).otherwise(SHARED)
    met = short.join(long, both).groupBy("id_a", "id_b").agg(F.sum(weight).alias("shared"))
    return met.filter(F.col("shared") >= SHARED).select("id_a", "id_b")


def _possible(classes: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The candidates, as earlier and later one, whose parity bits differ no more than two sets that match can."""
    pairs = materialize(candidates, "line-candidates")
    for side in "ab":
        pairs = pairs.join(classes.select(*(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "parity", "place"))), f"id_{side}")
    total = F.col("n_a") + F.col("n_b")
    differing = F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b")))
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (differing <= total - 2 * _ceil_of(total * percent, 100 + percent))
    ends = [F.struct(F.col(f"place_{side}").alias("place"), F.col(f"id_{side}").alias("id")) for side in "ab"]
    return pairs.filter(fits).select(F.least(*ends).alias("earlier"), F.greatest(*ends).alias("later"))


def _class_sets(docs: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """``id`` and ``tokens`` of the classes in the pairs, from the documents of their first lines."""
    ends = pairs.select(F.explode(F.array("earlier", "later")).alias("end"))
    asked = materialize(ends.select("end.id", "end.place").distinct(), "lines-asked")
    member = unused(docs, "is_member")
    held = with_membership(docs, "doc_id", id_bitmaps(asked.select("place.doc_id"), "doc_id"), member)
    held = held.filter(F.col(member) | F.col("doc_id").isNull()).select("row", "text")
    wanted = asked.groupBy("place.row").agg(F.collect_list(F.struct("id", "place.line_no")).alias("wanted"))
    texts = held.join(wanted, "row").select("wanted", F.split("text", "\n").alias("lines"))
    chosen = F.transform("wanted", lambda w: F.get("lines", w["line_no"]))
    sets = F.arrays_zip(F.transform("wanted", lambda w: w["id"]).alias("id"), _sets(chosen, min_words, lambda tokens: tokens).alias("tokens"))
    return materialize(texts.select(F.inline_outer(sets)).dropDuplicates(["id"]), "line-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``later`` of the pairs (earlier, later) whose whole sets match."""
    for side in ("earlier", "later"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("tokens").alias(f"{side}_tokens")), side)
    shared = F.size(F.array_intersect("earlier_tokens", "later_tokens"))
    compared = pairs.select("later", shared.alias("shared"), (F.size("earlier_tokens") + F.size("later_tokens")).alias("total"))
    return compared.filter((100 + percent) * F.col("shared") >= percent * F.col("total")).select("later").distinct()


def _matched(docs: DataFrame, pairs: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``id`` of the later classes of the pairs that match the earlier one.

    One match is enough. So every class is compared with one candidate first, and only those
    that it doesn't match go on to all others; sets move once a class and not once a pair.
    """
    sets = _class_sets(docs, pairs, min_words)
    directed = pairs.select(F.col("earlier.id").alias("earlier"), F.col("later.id").alias("later"))
    tried = materialize(directed.groupBy("later").agg(F.min("earlier").alias("earlier")), "line-firsts")
    known = materialize(_verified(tried, sets, percent), "line-firsts-known")
    rest = directed.join(known, "later", "left_anti").join(tried, ["later", "earlier"], "left_anti")
    return known.unionByName(_verified(materialize(rest, "line-rest"), sets, percent)).select(F.col("later").alias("id"))


def _later_classes(docs: DataFrame, classes: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Ids of the classes that match one whose first line stands earlier.

    A first round compares each class with the earliest one under a few of its tokens, which
    settles most of a group of near copies without all its pairs. The second takes all pairs
    under a token but those of two settled classes, and verifies those whose later one is not
    settled; no match is lost between them.
    """
    pairs = materialize(_possible(classes, _hub_pairs(classes), percent), "line-pairs")
    near = materialize(_matched(docs, pairs, percent, min_words), "line-near")
    done = id_bitmaps(near, "id")
    open_ = _candidates(with_membership(classes.select("id", "n", "place", "prefix"), "id", done, "done"), percent)
    pairs = _possible(classes, open_, percent)
    pairs = with_membership(pairs.withColumn("id", F.col("later.id")), "id", done, "done").filter(~F.col("done"))
    pairs = materialize(pairs.select("earlier", "later"), "line-pairs")
    return near.unionByName(_matched(docs, pairs, percent, min_words))


def find_later_lines(docs: DataFrame, percent: int = 80, min_words: int = 5) -> DataFrame:
    """``row`` and ``lines``: the numbers of a document's lines that have a match earlier.

    ``docs`` has ``doc_id``, ``row`` (a hash of the whole row) and ``text``; the order of lines is
    that of id, row and number.
    """
    ordered = _lines(docs, min_words, _by_rarity(_lines(docs, min_words)))
    described = materialize(_described(ordered, percent), "lines")
    classes = materialize(_classes(described), "line-classes")
    later = materialize(_later_classes(docs, classes, percent, min_words), "later-classes").withColumn("later", F.lit(True))
    marked = classes.select("id", "key", "key2", F.col("place").alias("kept"), "lines").join(later, "id", "left")
    marked = marked.filter("later or lines > 1").select("key", "key2", "kept", "later")
    gone = described.select("place", "key", "key2").join(marked, ["key", "key2"])
    gone = gone.filter(F.coalesce("later", F.lit(False)) | (F.col("place") != F.col("kept")))
    return gone.groupBy("place.row", "place.doc_id").agg(F.collect_set("place.line_no").alias("lines"))


def dedup_lines(
    docs: DataFrame, percent: int = 80, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the lines that match an earlier one, with ``n_lines`` and ``n_removed``.

    Two lines match when the sets of their pairs of neighbouring words, in lower case, have a
    Jaccard similarity of ``percent`` percent or more. Earlier is by id, then by line; a removed
    line removes others all the same. Lines under ``min_words`` words stay.

    Token sets are hashes of 64 bits, and equal sets one class. Tokens go by rarity; classes meet
    in their prefix tokens, pass the position, length and parity filters, and are verified.
    Documents that lose nothing are not moved.

    A null text stays null, with no lines; an empty one has one. A null id comes first; rows
    that share an id are told apart by their texts, and repeated rows lose the same lines. Other
    columns stay; columns named like the two counts are replaced. An empty table gives no rows.
    """
    row = unused(docs, "row_hash")
    hashed = docs.withColumn(row, _row_hash(id_col, text_col))
    texts = hashed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    gone = materialize_last(docs.sparkSession, lambda: find_later_lines(texts, percent, min_words), "gone-lines")
    member, drop = unused(hashed, "is_member"), unused(hashed, "drop_lines")
    flagged = with_membership(hashed, id_col, id_bitmaps(gone, "doc_id"), member)
    moved = F.col(member) | F.col(id_col).isNull()
    lost = gone.select(F.col("row").alias(row), F.col("lines").alias(drop))
    changed = flagged.filter(moved).join(lost, row, "left")
    same = flagged.filter(~moved).withColumn(drop, F.lit(None).cast("array<int>"))
    # a column, so that a text is split once and not again for each of its lines
    split = unused(changed, "split_lines")
    changed, same = (x.withColumn(split, F.split(text_col, "\n")) for x in (changed, same))
    lines = F.col(split)
    count = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    left = F.array_except(F.sequence(F.lit(0), count - 1), drop)
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    removed = F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop))
    counts = {"n_lines": count.cast("long"), "n_removed": removed.cast("long")}
    kept = [F.col(c) if c != text_col else text.alias(c) for c in docs.columns if c not in counts]
    return changed.unionByName(same).select(*kept, *(c.alias(name) for name, c in counts.items()))
