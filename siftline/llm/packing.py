"""Packing of tokenised documents into windows by best-fit decreasing.

Overlong documents are first cut into full windows, which need no search; what
is left of each document is dealt by a hash of its id into groups of about
``GROUP_DOCS`` documents.  A group is packed by one task: longest first, each
into the open window with the least room that still holds it, found in a
segment tree over remaining capacities.  Only lengths and checksums move, never
the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.chunks import byte_pairs
from siftline.llm.tables import whole

#: Documents packed together: enough that the windows left open at the end of a group are a small share.
GROUP_DOCS = 4096


class OpenWindows:
    """Open windows by remaining capacity; a segment tree tells the smallest capacity in use that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()  # one for each capacity from 0 up
        self.held = [0] * (2 * self.leaves)
        self.windows: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.held[node] += change
            node >>= 1

    def put(self, room: int, window: int, used: int) -> None:
        self.windows[room].append((window, used))
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int, int] | None:
        """Removes and returns (room, window, used) of the tightest window with room for ``need``."""
        held, node = self.held, need + self.leaves
        if not held[node]:
            while node > 1 and (node & 1 or not held[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if held[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return (room, *self.windows[room].pop())


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length, windows numbered from 0; equal lengths keep their order."""
    windows, offsets = [0] * len(lengths), [0] * len(lengths)
    open_windows, opened = OpenWindows(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_windows.take(lengths[i])
        if found is None:
            found, opened = (capacity, opened, 0), opened + 1
        room, window, used = found
        windows[i], offsets[i] = window, used
        if room > lengths[i]:
            open_windows.put(room - lengths[i], window, used + lengths[i])
    return windows, offsets


def _measure(json_path: str, ranks_path: str, pattern: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = byte_pairs(json_path, ranks_path, pattern)
        for batch in batches:
            sizes, sums = [], []
            for text in batch["text"]:
                ids = table.encode(text) + end
                sizes.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[at : at + 4 * window]) for at in range(0, len(ids), 4 * window)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "doc_tokens": sizes, "sums": sums, "pack": batch["pack"]})

    return measure


def _pack(window: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens"], kind="stable").reset_index(drop=True)
        sizes = rows["doc_tokens"].to_numpy()
        rest = sizes % window
        short = np.flatnonzero(rest)
        windows, offsets = best_fit_decreasing(rest[short].tolist(), window)
        next_window = max(windows, default=-1) + 1
        last = dict(zip(short.tolist(), zip(windows, offsets)))
        out = []
        for i, (doc, size, sums) in enumerate(zip(rows["doc_id"], sizes.tolist(), rows["sums"])):
            for k, check in enumerate(sums):
                if (k + 1) * window <= size:
                    out.append((doc, k * window, window, check, size, next_window, 0))
                    next_window += 1
                else:
                    out.append((doc, k * window, size - k * window, check, size, *last[i]))
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        frame = pd.DataFrame(out, columns=columns)
        frame["sequence_id"] += int(key[0]) << 32
        return frame

    return pack


def pack_documents(
    df: DataFrame, json_path: str, ranks_path: str, pattern: str, window: int = 2048, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone.  Repeated rows are packed as often
    as they occur, ties in length go by id, and an empty table gives no rows.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    groups = max(1, -(-df.count() // group_docs))
    rows = df.select(
        F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(groups)).alias("pack")
    )
    measured = rows.mapInPandas(
        _measure(json_path, ranks_path, pattern, window, end_id), f"doc_id {id_type}, doc_tokens long, sums array<long>, pack long"
    )
    return measured.groupBy("pack").applyInPandas(
        _pack(window),
        f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
