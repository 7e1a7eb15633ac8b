"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints. A bit of a document's 64-bit fingerprint is 1 if it is set in over half of its features' hashes.

Links. Fingerprints that differ in at most 3 bits are found by keys. A fingerprint is cut into three segments of 22, 21
and 21 bits, each a word of the 23-bit Golay code. Two words at most 1 bit apart share a key if one gives the number of
its next codeword and the other the numbers of the codewords next to itself and to all its neighbours (six at most).
Three errors fall on three segments in one of these ways, and a key is made for each:

* two segments have none: both segments as they are;
* one has none, and of the others at least one has a single error: that one as it is, this one's codeword;
* each has a single error: all three codewords.

So every link is found, and a key holds 33 bits or more of the fingerprint, which keeps chance meetings rare at any size.
Equal fingerprints are one row throughout, so copies cost nothing after the first aggregation.

Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import golay
from tidemark.llm._common import SLICE, map_rows, schema_of, text_rows
from tidemark.llm.components import components
from tidemark.session import materialize, ship

SEED, MAX_BITS = 42, 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of size words, space-joined; of all words if they are fewer; nothing if there are none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, seed)], np.uint64)
    starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    return np.array([h(joined[a : b - 1], seed) for a, b in zip(starts, starts[size:])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer; zero for none.

    Hashes go through a block at a time, so a long text needs no array of all its bits.
    """
    sums = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        sums += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long): of the shingles, repeats included. A null text is an empty one and has fingerprint 0."""
    rows = text_rows(docs, id_col, text_col)

    def run(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "fingerprint": [majority(shingle_hashes(words_of(t), shingle)) for t in c["text"]]}

    return map_rows(rows, run, schema_of(rows, ["doc_id"], "fingerprint long"))


def _segments(values: np.ndarray) -> list[np.ndarray]:
    bits = values.view(np.uint64)
    return [(bits >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]


def _keys(kind: int, parts: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Parts (values, width in bits) side by side under the number of the kind."""
    out = np.full(np.broadcast_shapes(*[p.shape for p, _ in parts]), kind, np.uint64)
    for values, width in parts:
        out = out << np.uint64(width) | values.astype(np.uint64)
    return out.view(np.int64)


def link_keys(values: np.ndarray, probing: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: those a fingerprint is filed under, or those it is looked for under (probing)."""
    exact = _segments(values)
    codes = []
    for s, (_, width) in zip(exact, SEGMENTS):
        if probing:
            codes.append(golay.nearby(s, width))
        else:
            codes.append((golay.index(s)[:, None], np.ones((len(s), 1), bool)))
    rows, keys, kind = [], [], 0

    def add(found: np.ndarray, keep: np.ndarray) -> None:
        n = np.broadcast_to(np.arange(len(values)).reshape(-1, *[1] * (found.ndim - 1)), found.shape)
        rows.append(n[keep])
        keys.append(found[keep])

    for i, j in ((0, 1), (0, 2), (1, 2)):
        found = _keys(kind, [(exact[i], 22), (exact[j], 22)])
        add(found, np.ones(len(found), bool))
        kind += 1
    for i in range(3):
        for j in range(3):
            if i != j:
                add(_keys(kind, [(exact[i][:, None], 22), (codes[j][0], 12)]), codes[j][1])
                kind += 1
    (a, ka), (b, kb), (c, kc) = codes
    add(_keys(kind, [(a[:, :, None, None], 12), (b[:, None, :, None], 12), (c[:, None, None, :], 12)]), ka[:, :, None, None] & kb[:, None, :, None] & kc[:, None, None, :])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(values: DataFrame, probing: bool) -> DataFrame:
    ship(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.column(0).slice(at, 512).to_numpy(zero_copy_only=False).astype(np.int64)
                rows, keys = link_keys(part, probing)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "f"])

    return values.mapInArrow(run, "key long, f long")


def links(values: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: all pairs a < b of the distinct, non-null fingerprints in the one column of values that differ in 1 to max_bits bits.

    The keys make sure of no more than 3 bits.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find links of {MAX_BITS} bits at most")
    # A fingerprint becomes up to 186 rows, so few rows are work for many tasks.
    values = values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), values.columns[0])
    filed = _keyed(values, False).withColumnRenamed("f", "a")
    sought = _keyed(values, True).select(F.col("key").alias("sought"), F.col("f").alias("b"))
    met = filed.join(sought.hint("merge"), (F.col("key") == F.col("sought")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long), component_id: the least doc_id that links lead to, its own included.

    Texts without words are linked like any other (fingerprint 0). Repeated rows come out each. A null id comes out with
    its fingerprint's component, which null ids don't name unless it has no other. No join broadcasts, so the driver's
    memory doesn't follow the number of fingerprints.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(distinct.select("fingerprint"), max_bits))
    rooted = distinct.join(linked.hint("merge"), F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written before it is joined: with a shuffle on either side Spark can split the partition of a fingerprint with very many copies.
    named = materialize(rooted.join(roots.hint("merge"), "root").select(F.col("fingerprint").alias("f"), "component_id"), "components")
    return prints.join(named.hint("merge"), F.col("fingerprint") == F.col("f")).select("doc_id", "fingerprint", "component_id")


def hex_of(fingerprint: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# Near-duplicates by the similarity of their shingles -----------------------------------------------------------------

#: A document has a key for each of BANDS bands of ROWS minima of its shingles' hashes. A pair of similarity j misses all
#: bands with a chance of (1 - j ** ROWS) ** BANDS, whatever the edits are: 3 in a million at 0.8.
BANDS, ROWS = 32, 5
#: Fixed odd factors: each one puts the hashes in another order.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
#: Documents under one key that one task puts in order, about.
RUN = 1024
#: Shingles that a worker hands over at a time.
CHUNK = 1 << 15


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of shingle hashes (ascending, distinct) have a Jaccard similarity of least or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: the hash of the least of the shingle hashes in each of its ROWS orders. None for no shingles.

    Hashes go through a block at a time, so a long text needs no array of all its products.
    """
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (FACTORS[:, None] * hashes[None, at : at + 1024]).min(axis=1), out=least)
    packed, width = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh3_64_intdigest(packed[n * width : (n + 1) * width], n) for n in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _described(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, words (16 bytes that stand for the sequence of words), print (fingerprint), f (band keys), both of the shingles."""
    rows = text_rows(docs, id_col, text_col)

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": c["doc_id"], "words": [], "print": [], "f": []}
        for text in c["text"]:
            words = words_of(text)
            out["words"].append(xxhash.xxh3_128_digest(b" ".join(words)))
            hashes = shingle_hashes(words, shingle)
            out["print"].append(majority(hashes))
            out["f"].append(band_keys(hashes))
        return out

    return map_rows(rows, run, schema_of(rows, ["doc_id"], "words binary, print long, f array<long>"))


def by_prints(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the fingerprints find of nodes (id, words, print, f): nodes with one more key in f, and pairs a, b (a < b).

    Fingerprints are linked by the Golay keys, as links() does it. The key is that of the class which chains of links
    make, so all documents of a class meet under it. Pairs are each document with the first one of its fingerprint and,
    for each linked fingerprint, its first document with those of its least and greatest partner below: they grow with
    the rows, and _classes() finds what they leave of a class.
    """
    firsts = materialize(nodes.groupBy("print").agg(F.min("id").alias("id")), "prints")
    met = materialize(links(firsts.select("print")), "met")
    linked = components(met)
    keyed = nodes.join(linked.hint("merge"), F.col("print") == F.col("node"), "left")
    keyed = keyed.select("id", "words", F.concat("f", F.array(F.xxhash64(F.lit("prints"), F.coalesce("root", "print")))).alias("f"))
    first = lambda c: firsts.select(F.col("print").alias(f"{c}_print"), F.col("id").alias(f"{c}_id")).hint("merge")
    same = nodes.join(first("x"), F.col("print") == F.col("x_print")).select(F.col("x_id").alias("a"), F.col("id").alias("b"))
    few = met.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high")).select("b", F.explode(F.array_distinct(F.array("low", "high"))).alias("a"))
    few = few.join(first("x"), F.col("a") == F.col("x_print")).join(first("y"), F.col("b") == F.col("y_print"))
    near = few.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
    return keyed, same.where("a < b").unionAll(near)


def _shared(nodes: DataFrame) -> DataFrame:
    """key, id, first, before: documents under the keys that several have, with the first one of the key and one before it.

    The first one comes from an aggregation that combines before the shuffle. The one before is that of the document's own
    run: a key's documents are dealt to runs of about RUN, so that no task orders all documents of a hot key.
    """
    rows = nodes.select("id", F.explode("f").alias("key"))
    counted = rows.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(counted, F.col("key") == F.col("k")).withColumn("run", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / RUN)))
    return rows.select("key", "id", "first", F.lag("id").over(Window.partitionBy("key", "run").orderBy("id")).alias("before"))


def _ends(shared: DataFrame) -> DataFrame:
    """a, b (a < b): each document with the first one of each of its keys and the one before it. Pairs grow with the rows."""
    ends = F.array_distinct(F.array("first", "before"))
    return shared.select(F.explode(ends).alias("a"), F.col("id").alias("b")).where("a < b").distinct()


def _open(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """id, root: the documents under keys whose documents are of several classes (linked: node, root)."""
    rooted = shared.select("key", "id").join(linked, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return rooted.join(mixed, F.col("key") == F.col("k"), "left_semi").select("id", "root").distinct()


def _shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """id, root, n, h: a row for each distinct shingle hash of the texts (id, root, text), n of them."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                id_, root, text = (batch.column(n)[at].as_py() for n in range(3))
                found = np.unique(shingle_hashes(words_of(text), shingle)).view(np.int64)
                for start in range(0, len(found), CHUNK):
                    part = found[start : start + CHUNK]
                    same = [pa.array(np.full(len(part), v, np.int64)) for v in (id_, root, len(found))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(part)], ["id", "root", "n", "h"])

    return texts.select("id", "root", "text").mapInArrow(run, "id long, root long, n long, h long")


def rare_pairs(shingles: DataFrame, least: float) -> DataFrame:
    """a, b (a < b): every pair of documents of different roots that can have a similarity of least or more, and few others.

    shingles has id, root, n, h, as _shingles() gives them. Shingles are put in one order, the rarest first. Of two sets
    with that similarity the shingles common to both are so many that the first n - ceil(least n) + 1 of each share one,
    and that the places of the shared one leave room for the others. A family of texts that differ from one another has
    its common shingles late in that order, so its members don't meet through them.
    """
    shared = shingles.groupBy(F.col("h").alias("k")).agg(F.count("*").alias("df")).where("df > 1")
    known = shingles.join(shared, F.col("h") == F.col("k"), "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "h")) - 1
    early = known.select("id", "root", "n", "h", "df", place.alias("p")).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9))
    early = materialize(early.where("df is not null").drop("df"), "early")
    x, y = (early.select(*[F.col(c).alias(f"{c}{side}") for c in early.columns]) for side in "xy")
    n, m, room = F.col("nx"), F.col("ny"), F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    able = (F.least(n, m) >= F.greatest(n, m) * least - 1e-9) & (room >= (n + m) * (least / (1 + least)) - 1e-9)
    met = x.join(y, (F.col("hx") == F.col("hy")) & (F.col("idx") < F.col("idy")) & (F.col("rootx") != F.col("rooty")) & able)
    return met.select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()


def _classes(shared: DataFrame, verified: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame], found: DataFrame | None = None) -> DataFrame:
    """node, root, as components() gives them, of all pairs that share a key and that verified() keeps (it gets and returns a, b).

    First _ends() and found (a, b) are compared, which makes a hot group of close copies one class. What is left are pairs of different
    classes under a key; rest() gets the documents under such keys (id, root) and gives those pairs that can be similar.
    """
    ends = _ends(shared) if found is None else _ends(shared).unionAll(found).distinct()
    linked = components(materialize(verified(ends), "links"))
    left = materialize(_open(shared, linked), "open")
    more = materialize(verified(rest(left)), "links")
    return components(linked.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(more)) if more.count() else linked


def similar_classes(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: the least doc_id among the texts that chains of pairs with a similarity of least or more join.

    Similarity is that of the sets of shingles of `shingle` words (all words, if fewer). Texts with the same words in the
    same order, A-Z in lower case, are one; those without words too. Candidates are documents whose fingerprints chains of links
    join, found by the Golay keys as in near_duplicates(), and those that share a band key of their shingles, which finds
    pairs whose fingerprints differ in more bits. Pairs of one such class or key that the first comparisons leave in
    different classes are found again by their rarest shingles, which misses none. Whole sets are compared. Rows of a null id are left out.
    """
    described = materialize(_described(docs.where(F.col(id_col).isNotNull()), shingle, id_col, text_col), "described")
    nodes = materialize(described.groupBy("words").agg(F.min("doc_id").cast("long").alias("id"), F.min("print").alias("print"), F.min("f").alias("f")), "nodes")
    nodes, found = by_prints(nodes)
    shared, found = materialize(_shared(nodes), "shared"), materialize(found, "found")
    texts = text_rows(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = materialize(texts.join(shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")
    side = lambda c: texts.select(F.col("id").alias(f"{c}_id"), F.col("text").alias(f"{c}_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, sets = batch.slice(at, SLICE), {}
                rows = list(zip(*[part.column(n).to_pylist() for n in range(4)]))
                for id_, text in {r[n]: r[n + 2] for r in rows for n in (0, 1)}.items():
                    sets[id_] = np.unique(shingle_hashes(words_of(text), shingle))
                kept = [r[:2] for r in rows if alike(sets[r[0]], sets[r[1]], least)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in kept], pa.int64()) for n in (0, 1)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
        return met.select("a", "b", "a_t", "b_t").mapInArrow(run, "a long, b long")

    def rest(open_docs: DataFrame) -> DataFrame:
        rows = texts.join(open_docs.select(F.col("id").alias("of"), "root"), F.col("id") == F.col("of"))
        return rare_pairs(materialize(_shingles(rows, shingle), "shingles"), least)

    linked = _classes(shared, verified, rest, found)
    named = nodes.join(linked, F.col("id") == F.col("node"), "left").select(F.col("words").alias("w"), F.coalesce("root", "id").alias("component_id"))
    named = materialize(named, "classes")
    return described.select("doc_id", "words").join(named, F.col("words") == F.col("w")).select("doc_id", "component_id")


def without_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of one document of each class of similar_classes(): that with the least id.

    Repeated rows of an id come out once; rows of a null id stay.
    """
    classes = similar_classes(docs, least, shingle, id_col, text_col)
    stays = classes.where("doc_id = component_id").select(F.col("component_id").alias("_stays")).distinct()
    kept = docs.join(stays, F.col(id_col) == F.col("_stays"), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
