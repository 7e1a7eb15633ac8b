"""Secret scanning with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. A ledger has, for each blob, the rule versions that
it was scanned under and what they found. Only pairs of a blob and a rule version that it lacks are scanned, each blob
once however many paths hold it, and findings are joined back to all paths. One row stands for a blob: the smallest (id)
among its copies. It is picked from (id, address) pairs alone, by an aggregation that combines copies before the shuffle;
rows of one id and blob are combined likewise, and the texts then meet the picks by (address, hash of the id), so that a
blob with any number of copies is spread over all tasks.

Every pattern reads a text in linear time: none can run again over what a failed match has read, but for the few
characters around it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import map_rows, schema_of

#: Kind, version (raised whenever the rule changes; blobs scanned under another are scanned again), pattern, group that
#: must have the least length, least length. The first three are the base kinds.
RULES = [
    ("assign", 1, re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 1, 12),
    ("access", 1, re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", 1, re.compile(r"[0-9a-f]+"), 0, 16),
    ("pem", 1, re.compile(r"-----BEGIN (?:[A-Z]++ )*+(?<=PRIVATE )KEY-----"), 0, 0),
    ("forge", 1, re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    ("jwt", 2, re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), 0, 40),
]
BASE = ("assign", "access", "hex")
KINDS = [k for k, *_ in RULES]


def rule_versions() -> list[str]:
    """kind@version of each rule as it stands."""
    return [f"{k}@{v}" for k, v, *_ in RULES]


#: The same matches as of the rule "hex" after its length test, found without stopping at each short run.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")

#: A blob with findings meets its paths in so many places, so that one with very many copies is spread out.
SALTS = 16

SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


def scan(text: str, rules: list[tuple] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind in the order of RULES.

    Matches are the leftmost, non-overlapping ones of each kind; those that fail the length test are dropped, without
    a second search inside them. rules: those of RULES to scan by, all if it is None.
    """
    found = []
    for n, (kind, _, pattern, group, least) in enumerate(RULES if rules is None else rules):
        if kind == "assign" and ":" not in text and "=" not in text:
            continue
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), n, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def address(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, blob, text: each version and its address; a null text has the address of an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """blob, rules, spans: a row for each blob of versions with the rule versions that ledger lacks for it, and what they find.

    ledger has these same columns; to add the result to it makes it know these pairs. Repeated rows and nulls in either
    column are fine: a blob is scanned and comes out once.
    """
    rules, now = list(zip(rule_versions(), RULES)), F.array(*map(F.lit, rule_versions()))
    rows = address(versions, id_col, text_col)
    picked = rows.groupBy("blob").agg(F.min("id").alias("id"), now.alias("todo"))
    if ledger is not None:
        known = ledger.groupBy(F.col("blob").alias("known_blob")).agg(F.flatten(F.collect_set("rules")).alias("known"))
        picked = picked.join(known, F.col("blob") == F.col("known_blob"), "left")
        picked = picked.select("blob", "id", F.array_except("todo", F.coalesce("known", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    picked = picked.select(F.col("blob").alias("p_blob"), F.xxhash64("id").alias("p_place"), "todo")
    # xxhash64 has a value for null ids too. Two ids of one blob with equal hashes would be combined, which is right as well.
    once = rows.groupBy("blob", F.xxhash64("id").alias("place")).agg(F.first("text").alias("text"))
    texts = once.join(picked, (F.col("blob") == F.col("p_blob")) & (F.col("place") == F.col("p_place"))).select("blob", "text", "todo")

    def run(c: dict[str, list]) -> dict[str, list]:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, [r for v, r in rules if v in todo])] for t, todo in zip(c["text"], c["todo"])]
        return {"blob": c["blob"], "rules": c["todo"], "spans": spans}

    return map_rows(texts, run, schema_of(texts, ["blob"], f"rules array<string>, spans {SPANS}"))


def update(versions: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger kept as a Parquet table at path, after what it lacks for versions has been scanned and appended."""
    spark = versions.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    scan_unseen(versions, spark.read.schema(LEDGER).parquet(path) if there else None, id_col, text_col).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _found(ledger: DataFrame) -> DataFrame:
    """found_blob, found (spans of the rules as they stand, by start, then kind), salt: SALTS rows for each blob with any."""
    now = F.array(*map(F.lit, rule_versions()))
    version = F.element_at(F.create_map(*[F.lit(x) for k, v, *_ in RULES for x in (k, f"{k}@{v}")]), F.col("span.kind"))
    rows = ledger.where((F.size("spans") > 0) & F.arrays_overlap("rules", now)).select("blob", "rules", F.explode("spans").alias("span"))
    rows = rows.where(F.array_contains("rules", version))
    key = F.struct(F.col("span.start").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("span.kind")).alias("n"), F.col("span.kind").alias("kind"), F.col("span.end").alias("end"))
    sets = rows.groupBy(F.col("blob").alias("found_blob")).agg(F.array_sort(F.collect_set(key)).alias("found"))
    spans = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return sets.select("found_blob", spans.cast(SPANS).alias("found"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def findings(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, blob, spans: every version, with the spans that the ledger has for its blob (empty if none)."""
    # Salted by the row's place, so that null or repeated ids are spread too.
    rows = address(versions, id_col, text_col).select("id", "blob", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("at"))
    joined_rows = rows.join(_found(ledger), (F.col("blob") == F.col("found_blob")) & (F.col("at") == F.col("salt")), "left")
    return joined_rows.select("id", "blob", F.coalesce("found", F.array().cast(SPANS)).alias("spans"))


def without_secrets(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs, all columns, with the ledger's spans masked in the text; other texts, and null ones, stay as they are.

    Columns that begin with an underscore are taken.
    """
    known = _found(ledger).select(F.col("found_blob").alias("_of"), F.col("found").alias("_spans"), F.col("salt").alias("_salt"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_blob", F.unhex(F.sha2(text, 256))).withColumn("_at", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined_rows = rows.join(known, (F.col("_blob") == F.col("_of")) & (F.col("_at") == F.col("_salt")), "left")
    masked = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(redact(text, F.col("_spans"), mask))
    return joined_rows.withColumn(text_col, masked).select(*docs.columns)


def count_of(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with the characters of the spans replaced, overlapping spans as one.

    spans must be ordered by start, as scan() gives them.
    """
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        done = F.when(fresh, F.concat(acc["done"], before, F.lit(mask))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    return F.aggregate(spans, start, step, finish)
