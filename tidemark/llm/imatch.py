"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions alone.

The lexicon holds all terms that at least LEAST_SHARE and at most MOST_SHARE of the documents hold, and two at least: a
band of inverse document frequency. All documents together have no more terms than words, so the lexicon has at most
(mean number of distinct terms of a document) / LEAST_SHARE terms, whatever the size of the corpus. It is a literal of the
query: a table of places, each with the terms whose hash belongs there, so that a term is looked up without a join.

A text's distinct lexicon terms, sorted, are hashed once for each of LEVELS * PARTS random subsets of the lexicon, whole:
level l keeps a share of 2 ** -l of it, in PARTS parts. Texts of different length need subsets of different size: a large
one differs after the least edit, a small one has no term of a short text.

Likeness of two fingerprints is the share of equal hashes among the subsets that either text has terms of, on the levels
that are fine enough to tell: those on which not every subset has terms of both texts, and above them none if there are
such levels.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS, PARTS = 12, 8
#: Bits of a term's hash that say which levels keep it begin here.
DEPTH = 15
#: Shares of the documents between which the lexicon's terms lie: idf from ln 10 to ln 1000.
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
#: Documents of one range of ids, about; ranges that the search for a document's range leaves to its second step.
RANGE, STEP = 4096, 128


def terms_of(text: Column) -> Column:
    """Distinct hashes of the text's words (runs of letters and digits, in lower case); a null text has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> list[list[int]]:
    """The terms (hashes) of the band, each in the list of its place; the places are a power of two, at least as many as terms."""
    texts = docs.select(F.col(text_col).alias("text"))
    every, least = texts.count(), F.lit(2)
    counted = texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counted.where((F.col("df") >= F.greatest(least, F.lit(every * least_share))) & (F.col("df") <= F.lit(every * most_share)))
    terms = sorted(r.term for r in band.select("term").collect())  # bounded, see above
    places = [[] for _ in range(1 << max(0, len(terms) - 1).bit_length())]
    for t in terms:
        places[t & len(places) - 1].append(t)
    return places


def with_hashes(df: DataFrame, lexicon_terms: list[list[int]], text_col: str, out: str) -> DataFrame:
    """df and an array column out: a hash for each subset of the lexicon, null where the text has none of its terms.

    A text without any term of the lexicon is fingerprinted by all its terms. Bits of a term's hash that its place doesn't
    take say which levels keep it, and its part on each.
    """
    table = F.from_json(F.lit(json.dumps(lexicon_terms)), F.lit("array<array<bigint>>"))  # folded into a literal
    places, tmp = F.lit(len(lexicon_terms) - 1).cast("long"), f"_{out}_terms"
    df = df.withColumn(tmp, F.sort_array(terms_of(F.col(text_col))))  # not array_sort(), which evaluates an expression to compare
    df = df.withColumn(out, F.filter(tmp, lambda t: F.array_contains(F.get(table, t.bitwiseAND(places).cast("int")), t)))
    df = df.withColumn(tmp, F.when(F.size(out) > 0, F.col(out)).otherwise(F.col(tmp)))
    names = [f"_{out}_{n}" for n in range(LEVELS)]
    for n, name in enumerate(names):  # each level is a part of the one before
        df = df.withColumn(name, F.filter(names[n - 1], _kept(n)) if n else F.col(tmp))
    hashed = [F.transform(F.lit([k << 27 + 3 * n for k in range(PARTS)]).cast("array<bigint>"), _part(F.col(name), n)) for n, name in enumerate(names)]
    return df.withColumn(out, F.concat(*hashed)).drop(tmp, *names)


def _kept(n: int):
    return lambda t: t.bitwiseAND(F.lit(1 << DEPTH + n).cast("bigint")) == 0


def _part(level: Column, n: int):
    """Of the terms whose bits of the part, left in their places, are k."""

    def of(k: Column) -> Column:
        own = F.filter(level, lambda t: t.bitwiseAND(F.lit(PARTS - 1 << 27 + 3 * n).cast("bigint")) == k)
        return F.when(F.size(own) > 0, F.xxhash64(own).bitwiseAND(F.lit(0xFFFFFFFF)))

    return of


def fingerprint_of(values: Column) -> Column:
    """Eight hex digits for each subset, zeros for one without terms."""
    return F.array_join(F.transform(values, lambda h: F.lower(F.lpad(F.hex(F.coalesce(h, F.lit(0))), 8, "0"))), "")


def _counts(a: Column, b: Column, level: int) -> tuple[Column, Column, Column]:
    """Of one level's subsets: how many hashes are equal, how many there are in both lists, how many subsets have terms of both texts."""
    x, y = (F.slice(c, level * PARTS + 1, PARTS) for c in (a, b))
    equal = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: F.coalesce(e, F.lit(False))))
    filled, other = (F.size(F.array_compact(c)) for c in (x, y))
    both = F.size(F.array_compact(F.zip_with(x, y, lambda p, q: p + q)))
    return equal, filled + other, both


def _with(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either has, on the fine levels (see above); 1 if neither has any."""
    levels = F.array(*[F.struct(e.alias("equal"), n.alias("hashes"), both.alias("both")) for e, n, both in (_counts(a, b, k) for k in range(LEVELS))])
    either = lambda s: s["hashes"] - s["both"]
    zero = F.struct(F.lit(0).alias("equal"), F.lit(0).alias("either"))
    total = lambda used: F.aggregate(used, zero, lambda acc, s: F.struct((acc["equal"] + s["equal"]).alias("equal"), (acc["either"] + either(s)).alias("either")))
    share = lambda sums: F.when(sums["either"] == 0, 1.0).otherwise(sums["equal"] / sums["either"])

    def of(every: Column) -> Column:
        fine = F.filter(every, lambda s: (s["both"] < PARTS) & (either(s) > 0))
        return _with(_with(fine, lambda f: total(F.when(F.size(f) > 0, f).otherwise(every))), share)

    return _with(levels, of)


def cuts_of(rows: DataFrame) -> list[tuple[int | None, int]]:
    """The first (id, order) of each range of about RANGE rows but for the lowest, ascending; rows has id and order."""
    slim = rows.select("id", "order")
    ranges = max(1, -(-slim.count() // RANGE))
    firsts = slim.repartitionByRange(ranges, F.col("id").asc_nulls_first(), "order").select(F.struct("id", "order").alias("key"), F.spark_partition_id().alias("part"))
    found = sorted((r.first.id is not None, r.first.id or 0, r.first.order) for r in firsts.groupBy("part").agg(F.min("key").alias("first")).collect())
    return [(i if some else None, o) for some, i, o in found]


def with_following(rows: DataFrame, columns: list[str], id_col: str = "doc_id", prepare=lambda df: df) -> DataFrame:
    """rows and, for each of columns, next_<column> of the row after by ascending id (after the last: the first).

    Rows are in the order of (id, a hash of their other columns), null ids first, and are cut into ranges of about RANGE
    of them at quantiles of that order, so that no id, null or outlying, makes a range large but by equal rows. A range
    is ordered by one task, and a copy of the next range's first row stands at its end, so that no task needs all rows.
    prepare makes columns that others need; it runs once a row, after the shuffle. Names that begin with an underscore
    are taken.
    """
    others = [c for c in rows.columns if c != id_col]
    rows = rows.withColumn("_order", F.xxhash64(*others))
    cuts = cuts_of(rows.select(F.col(id_col).alias("id"), F.col("_order").alias("order")))
    if not cuts:
        return _with_next(prepare(rows.withColumns({"_range": F.lit(0), "_copy": F.lit(0)})), columns, id_col)
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.col("_order").alias("order"))
    # How many of the cuts aren't above the key, by two steps of a search; the lowest cut is the first key of all.
    blocks = [cuts[n : n + STEP] for n in range(0, len(cuts), STEP)]
    kind = "array<struct<id:bigint,order:bigint>>"
    listed = lambda keys, kind: F.from_json(F.lit(json.dumps(keys)), F.lit(kind))
    named = [[{"id": i, "order": o} for i, o in block] for block in blocks]
    upto = lambda keys: F.size(F.filter(keys, lambda c: c <= key))
    block = F.greatest(F.lit(1), upto(listed([b[0] for b in named], kind))) - 1
    rows = rows.withColumn("_block", block)
    rows = rows.withColumn("_range", F.greatest(F.lit(1), F.col("_block") * STEP + upto(F.get(listed(named, f"array<{kind}>"), F.col("_block")))) - 1).drop("_block")
    # The first row of each range is also the last of the range before; that of the lowest, of the highest.
    heads = rows.sparkSession.createDataFrame([(i, o, (n - 1) % len(cuts)) for n, (i, o) in enumerate(cuts)], "_id long, _at long, _to int")
    copies = rows.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_order") == F.col("_at")))
    copies = copies.dropDuplicates(["_to"]).withColumn("_range", F.col("_to")).drop("_id", "_at", "_to")
    every = rows.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))
    return _with_next(prepare(every.repartition("_range")), columns, id_col)


def _with_next(rows: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    order = Window.partitionBy("_range").orderBy("_copy", F.col(id_col).asc_nulls_first(), "_order")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where("_copy = 0").drop("_copy", "_range", "_order")


def neighbours(docs: DataFrame, lexicon_terms: list[list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, and the hashes of the text, the edited text and the next text (hashes, edited_hashes, next_hashes).

    Edited: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document's, by
    ascending id. A null text is an empty one; repeated rows come out each; one document alone is its own next.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_following(rows, ["text", "hashes"], prepare=lambda df: with_hashes(df, lexicon_terms, "text", "hashes"))
    cut = F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = with_hashes(rows, lexicon_terms, "edited", "edited_hashes")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "hashes", "edited_hashes", "next_hashes")
