"""Document fingerprints by winnowing, in DataFrame functions only.

A text's k-grams of code points are hashed (all windows of ``k``), and of every ``window`` consecutive hashes the smallest
is taken, the rightmost of equal ones. The taken (hash, position) pairs are the fingerprint: any common passage of
``k + window - 1`` code points gives two texts a common hash, and no passage under ``k`` ever does (but for collisions of
31 bits).

A hash and its position share one long, hash first and position complemented, so the least long is the rightmost least
hash. Window minima come from three passes that each take the least of 2 or 4 elements. Arrays are bound to lambda
variables (``let``): read from a column, a value would be copied for every element. Long texts are read in stretches.

Documents follow each other by id, then text hash. For neighbours, ids alone are first split into ranges; texts then
move once, to their range, with the first document of the next range added as a sentinel, and a window function
reaches the next document. Nothing is ordered in one task. Rows equal in id and text are counted first: of those that are there
as often as a range has rows, one goes to its range and the others, which are followed by their equal, are computed once and
dealt out by number.

Defined results: null text is empty; an empty text has an empty fingerprint, a text under k is one k-gram; a null id
comes first; rows with the same id and text follow each other in either order (the results are the same); a sole
document is its own next; an empty table gives no rows. Likeness is the Jaccard similarity of the distinct hashes: 1 for
two empty fingerprints, 0 for one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import docs_of, write_shared
from riskweave.llm.linededup import LEAST

LOW = 0xFFFFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and then read in place."""
    return F.transform(F.array(value), body)[0]


def grams(code: Column, k: int) -> Column:
    """hash << 32 | (LOW - position) of every k-gram of a text that is not empty, positions from 1; code: its UTF-32."""
    n = (F.octet_length(code) / 4).cast("int")
    places = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
    return let(code, lambda b: F.transform(places, lambda i: F.xxhash64(F.substring(b, i * 4 - 3, F.lit(4 * k))).bitwiseAND(F.lit(0x7FFFFFFF00000000)).bitwiseOR(F.lit(LOW) - i)))


def minima(keys: Column, window: int) -> Column:
    """The least key of every whole window (of all keys, where there are fewer)."""
    steps, span = [], 1
    while span < window:
        fold = 4 if window % (span * 4) == 0 else 2
        steps.append((span, fold))
        span *= fold
    if span != window:
        raise ValueError("window must be a power of 2")

    def passes(a: Column, left: list[tuple[int, int]]) -> Column:
        if not left:
            return F.slice(a, 1, F.greatest(F.size(a) - (window - 1), F.least(F.size(a), F.lit(1))))
        (span, fold), rest = left[0], left[1:]
        return let(F.transform(a, lambda x, i: F.least(x, *[F.get(a, i + span * f) for f in range(1, fold)])), lambda b: passes(b, rest))

    return let(keys, lambda a: passes(a, steps))


def winnow(text: Column, k: int, window: int, stretch: int = 1 << 14) -> Column:
    """The taken keys of a text, in order of position.

    A stretch of windows at a time, so that a long text needs arrays of that length only, beside its taken keys."""
    more = k + window - 2  # code points that the last window of a stretch goes on

    def part(b: Column, c: Column) -> Column:
        own = F.array_distinct(minima(grams(F.substring(b, c * (4 * stretch) + 1, F.lit(4 * (stretch + more))), k), window))
        return F.transform(own, lambda x: x - c * stretch)

    windows = F.greatest(F.length(text) - more, F.lit(1))
    stretches = F.sequence(F.lit(0), F.floor((windows - 1) / stretch).cast("int"))
    taken = let(F.encode(text, "UTF-32"), lambda b: F.flatten(F.transform(stretches, lambda c: part(b, c))))
    return F.when(F.length(text) > 0, F.array_distinct(taken)).otherwise(F.array().cast("array<bigint>"))


def shown(keys: Column) -> Column:
    """The fingerprint as text: hash:position, ..."""
    return F.array_join(F.transform(keys, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 32))), F.lit(":"), (F.lit(LOW) - x.bitwiseAND(F.lit(LOW))).cast("string"))), ",")


def hashes(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda x: F.shiftrightunsigned(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1.0)))


def ranges(keyed: DataFrame, n: int) -> list:
    """The least (did, th) of each of about ``n`` ranges of about equal numbers of rows."""
    ids = keyed.select("did", "th").repartitionByRange(n, "did", "th")
    got = ids.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("did", "th")).alias("least")).collect()
    return sorted((r.least.did, r.least.th) for r in got)


def bounds_of(least: list) -> Column:
    """The bounds as an array of (did, th), one literal in the plan whatever their number."""
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    return F.arrays_zip(longs([d for d, _ in least]), longs([t for _, t in least])).cast("array<struct<did:bigint,th:bigint>>")


def range_of(least: list) -> Column:
    """The number of the range of struct(did, th): a search among every g-th bound, then among g bounds."""
    bounds = bounds_of(least)
    g = max(1, int(len(least) ** 0.5))
    key = F.struct("did", "th")
    at = lambda c: c * g + F.size(F.filter(F.slice(bounds, c * g + 1, F.lit(g)), lambda b: b <= key)) - 1
    return let(F.greatest(F.size(F.filter(bounds_of(least[::g]), lambda b: b <= key)) - 1, F.lit(0)), at)


def compared(rows: DataFrame, k: int, window: int, edit: int, *more: str) -> DataFrame:
    """Results of rows (did, text, keys, next_text, next_keys), with the columns ``more`` of theirs."""
    n = F.length("text")
    cut = n - F.floor(n / edit).cast("int")
    # Windows that lie in the kept part are those of the text itself: only the rest of the edited text is read again.
    rows = rows.withColumn("kept", F.greatest(cut - (k + window - 2), F.lit(0)))
    rows = rows.withColumn("inserted", F.substring("next_text", F.lit(1), F.floor(n / edit).cast("int")))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), cut), "inserted"))
    tail = winnow(F.substring("edited", F.col("kept") + 1, F.length("edited")), k, window)
    moved = let(tail, lambda a: F.transform(a, lambda x: x - F.col("kept")))
    # what the last kept window takes is the last of the kept windows' keys
    last = F.array_min(grams(F.encode(F.substring("text", F.col("kept"), F.lit(k + window - 1)), "UTF-32"), k)) - F.col("kept") + 1
    before = F.slice("keys", F.lit(1), F.array_position("keys", last).cast("int"))
    edited_keys = F.when(F.col("kept") == 0, tail).when(F.col("inserted") == "", before).otherwise(F.array_distinct(F.concat(before, moved)))
    rows = rows.withColumn("edited_keys", edited_keys)
    return rows.withColumns({"a": hashes(F.col("keys")), "b": hashes(F.col("edited_keys")), "c": hashes(F.col("next_keys"))}).select(
        F.when(F.col("did") != LEAST, F.col("did")).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("keys")).alias("fingerprint"), shown(F.col("edited_keys")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), F.size("keys").alias("n_taken"), *more)


def repeated(keyed: DataFrame, tally: DataFrame, n_ranges: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows that go to the ranges, one row of each frequent (id, text) with its number ``n``, rows a range has).

    A row that is there as often as a range has rows on average is frequent: there are at most ``n_ranges`` such, whatever
    the table. They are thinned to one row by partial aggregation before anything moves; rarer repeats stay as they are."""
    total = tally.agg(F.sum("n")).first()[0] or 0
    per_range = max(2, -(-total // n_ranges))
    frequent = [(r.did, r.th, r.n) for r in tally.where(F.col("n") >= per_range).collect()]
    if not frequent:
        return keyed, None, per_range
    known = keyed.sparkSession.createDataFrame(frequent, "did long, th long, n long")
    marked = keyed.join(F.broadcast(known), ["did", "th"], "left")  # at most n_ranges rows
    single, _ = write_shared(marked.where("n is not null").groupBy("did", "th").agg(F.first("text").alias("text"), F.first("n").alias("n")), "repeated")
    return marked.where("n is null").drop("n").unionByName(single.drop("n")), single, per_range


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 16, window: int = 32, edit: int = 4, per_partition: int = 4) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last 1/edit of its code points replaced by the first as
    many of the next document), and their likeness and that to the next document. Ranges: ``per_partition`` x shuffle partitions."""
    keyed = docs_of(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LEAST)).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("th", F.xxhash64("text"))
    n_ranges = per_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tally, _ = write_shared(keyed.groupBy("did", "th").agg(F.count(F.lit(1)).alias("n")), "rows")
    keyed, single, per_range = repeated(keyed, tally, n_ranges)
    least = ranges(tally, n_ranges) or [(LEAST, LEAST)]
    n_ranges = len(least)
    placed = keyed.withColumn("range", range_of(least))
    # Each range also gets the first document of the next one (the last range: of the first), after its own.
    firsts = placed.where(F.struct("did", "th") == F.get(bounds_of(least), F.col("range"))).dropDuplicates(["range"])
    rows = placed.withColumn("sentinel", F.lit(0)).unionByName(firsts.withColumns({"range": F.pmod(F.col("range") + (n_ranges - 1), F.lit(n_ranges)), "sentinel": F.lit(1)}))
    order = ["sentinel", "did", "th"]
    rows = rows.repartition("range").sortWithinPartitions("range", *order).withColumn("keys", winnow(F.col("text"), k, window))
    following = Window.partitionBy("range").orderBy(*order)
    rows = rows.select("*", F.lead("text").over(following).alias("next_text"), F.lead("keys").over(following).alias("next_keys")).where("sentinel = 0")
    out = compared(rows, k, window, edit)
    if single is None:
        return out
    # The last of equal rows went to the ranges; every other one is followed by its equal. They are dealt out by a range's rows.
    copies = compared(single.withColumn("keys", winnow(F.col("text"), k, window)).withColumns({"next_text": F.col("text"), "next_keys": F.col("keys")}), k, window, edit, "n")
    runs = copies.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("n") - 1, F.lit(per_range)))).repartition(n_ranges, "doc_id", "fingerprint", "first")
    return out.unionByName(runs.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + (per_range - 1), F.col("n") - 1)))).select(*out.columns))
