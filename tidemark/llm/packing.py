"""Best-fit-decreasing packing of token ids into windows of a fixed capacity.

Documents above the capacity are first cut into full windows, which need no search. What is left of each document goes,
longest first, into the open window with the least room that still holds it; a segment tree over the room left, with
the number of open windows at each leaf, finds it in log2(capacity) steps.

The search runs in groups of about GROUP pieces, dealt out evenly: a group is packed by one task, groups are packed
independently, and their number grows with that of the pieces. Full windows take no part in it and aren't shuffled. The
tree has as many leaves as a window has tokens, so memory is that of the group's rows. The last, less full windows of a
group are the price: about one in thousands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import map_rows, schema_of, text_rows
from tidemark.llm.tokens import encoder
from tidemark.session import materialize, ship

#: Pieces that one task packs together.
GROUP = 4096
#: Numbers of the sequences of full windows begin here.
FULL = 1 << 62


class RoomTree:
    """Open windows by the room that is left in them."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least need, and that room; None if none is open."""
        node, count = need + self.size, self.count
        while not count[node]:  # up to the first subtree to the right that holds a window
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:
                return None
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.windows[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length (0 < length <= capacity), in this order, which must be a falling one."""
    tree, window_of, offset_of, opened = RoomTree(capacity), [], [], 0
    for n in lengths:
        found = tree.take(n) if n < capacity else None
        window, room = found or (opened, capacity)
        opened += found is None
        window_of.append(window)
        offset_of.append(capacity - room)
        if room > n:
            tree.put(room - n, window)
    return window_of, offset_of


def cut_windows(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids, doc_tokens: each document's ids and end_id, cut into full windows and a rest.

    ids are little-endian unsigned 32-bit integers. A null or empty text is the end id alone; repeated rows are cut
    each; other columns of docs are left out.
    """
    rows, end = text_rows(docs, id_col, text_col), np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def run(c: dict[str, list]) -> dict[str, list]:
        found = []
        for doc, ids in zip(c["doc_id"], encoder(path).ids(c["text"])):
            ids += end
            n = len(ids) // 4
            found += [(doc, at, min(capacity, n - at), ids[4 * at : 4 * (at + capacity)], n) for at in range(0, n, capacity)]
        return dict(zip(names, map(list, zip(*found)))) if found else {k: [] for k in names}

    return map_rows(rows, run, schema_of(rows, ["doc_id"], "start long, length long, ids binary, doc_tokens long"))


def pack(windows: DataFrame, capacity: int = 1024, group: int = GROUP) -> DataFrame:
    """windows with sequence_id and offset (columns doc_id, start, length are needed; the others are carried along).

    The pieces are written once, so that they can be counted and keep their order if a task is run again. They are dealt
    to groups by their place in that table, so null or repeated ids don't gather in one; equal rows are packed each. Within
    a group ties go by doc_id (nulls last) and start. Which pieces share a sequence may differ from one run to the next.
    """
    ship(windows.sparkSession)
    rows = materialize(windows.drop("sequence_id", "offset", "pack_group"), "pieces")
    schema = T.StructType(rows.schema.fields + T._parse_datatype_string("sequence_id long, offset long").fields)
    place, short = F.monotonically_increasing_id(), F.col("length") < capacity
    full = rows.withColumn("sequence_id", place + F.lit(FULL)).withColumn("offset", F.lit(0).cast("long")).where(~short)
    groups = max(1, -(-rows.where(short).count() // group))
    rest = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", place), F.lit(groups))).where(short)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["pack_group"])
        order = pa.compute.sort_indices(rows.select(["length", "doc_id", "start"]), [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        rows = rows.take(order)
        window, offset = best_fit(rows.column("length").to_pylist(), capacity)
        ids = np.array(window, np.int64) + (key[0].as_py() << 32)
        return rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64()))

    return rest.groupBy("pack_group").applyInArrow(run, schema).unionByName(full)
