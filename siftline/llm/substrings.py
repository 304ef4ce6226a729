"""Removal of byte strings that stand in more than one place, by suffix arrays over what anchors bring together.

1. Every document is cut into contexts: the windows of 200 bytes that share an
   anchor (see ``anchors``), about 70 of them.  An equal window elsewhere has an
   equal anchor, so contexts only need comparing under one anchor hash.
2. A context that stands elsewhere byte for byte is covered as a whole.
   Contexts of an anchor that nothing else has are done, too.
3. The bytes of the rest, mostly the ends of repeated passages, come together by
   anchor.  They are cut into pieces of a few windows; a piece whose common
   core is unique has no repeat.  The others are joined into one string, whose
   suffix array (see ``lyndon``) puts equal windows side by side.
4. Covered spans are united per document and removed.

An anchor with more than about a thousandth of all contexts, such as one at the
edge of a passage that a third of all documents quote, is settled by counting
hashes of its windows instead, which are first counted where they are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.anchors import WINDOW, Rolling, anchors, mix
from siftline.llm.lyndon import suffix_array
from siftline.llm.tables import stored, whole

#: Anchors, and bytes of contexts, that one task holds at a time.
TASK_ANCHORS = 200_000
TASK_BYTES = 2_000_000
#: Counters of the summaries that find frequent anchors, and so the most that are broadcast.
COUNTERS = 1023
#: Offsets of windows from their anchor that are judged together.
PIECE = 8
#: Symbols of one suffix array.
TEXT_SYMBOLS = 150_000


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each anchor: hashes of it and its context, document, first window, number of windows, offset of the anchor."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            out = []
            for doc, text in zip(part["doc_id"], part["text"]):
                data = text.encode()
                if len(data) < WINDOW:
                    continue
                rolling = Rolling(data)
                position, gram, first, last = anchors(data, rolling)
                context = rolling.of(first, last + WINDOW) ^ mix((position - first).astype(np.uint64))
                out.append((np.full(len(gram), doc), gram, context, first, last - first + 1, position - first))
            columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
            yield pd.DataFrame({
                "doc_id": columns[0], "gram": columns[1].view(np.int64), "context": columns[2].view(np.int64), "first": columns[3].astype(np.int32),
                "windows": columns[4].astype(np.int16), "off": columns[5].astype(np.int16), "times": np.ones(len(columns[0]), np.int32),
            })


_CONTEXT = "doc_id long, gram long, context long, first int, windows short, off short, times int"


def _frequent(counters: int):
    """Misra-Gries summary of the anchors of a task."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            gram, times = np.unique(batch["gram"].to_numpy(), return_counts=True)
            often = times > 1
            counts.update(dict(zip(gram[often].tolist(), times[often].tolist())))
            counts.update(gram[~often].tolist())
            if len(counts) > counters:
                cut = sorted(counts.values(), reverse=True)[counters]
                counts = Counter({k: v - cut for k, v in counts.items() if v > cut})
        yield pd.DataFrame({"gram": list(counts), "seen": list(counts.values())}, dtype="int64")

    return summarise


def frequent_grams(contexts: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Anchors of at least a ``counters``-th of all contexts; at most ``counters`` rows."""
    total = contexts.count()
    return (
        contexts.select("gram").mapInPandas(_frequent(counters), "gram long, seen long").groupBy("gram").agg(F.sum("seen").alias("seen"))
        .where(F.col("seen") * (counters + 1) > total).orderBy(F.desc("seen"), "gram").limit(counters).select("gram")
    )


def _collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts that a batch holds several times: all are marked as repeated, and one goes on with their number."""
    for batch in batches:
        batch = batch.sort_values(["gram", "context", "doc_id", "first"], kind="stable", ignore_index=True)
        key = batch["gram"].to_numpy(), batch["context"].to_numpy()
        lead = np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])])[: len(batch)]
        number = np.cumsum(lead) - 1
        held = np.bincount(number, weights=batch["times"]).astype(np.int32) if len(batch) else np.zeros(0, np.int32)
        batch["times"] = held[number] if len(batch) else batch["times"]
        batch["lead"] = lead
        yield batch[lead | (batch["times"] > 1).to_numpy()]


def _met(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the contexts of some anchors: which are repeated as a whole, and which must be looked at."""
    rows = rows.sort_values(["gram", "context", "doc_id", "first"], kind="stable", ignore_index=True)
    gram, context = rows["gram"].to_numpy(), rows["context"].to_numpy()
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    lead = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
    number, family = np.cumsum(lead) - 1, np.cumsum(new_gram) - 1
    times = np.bincount(number, weights=rows["times"])[number].astype(np.int32)
    kinds = np.bincount(family, weights=lead)[family]
    alone = np.bincount(family, weights=(times == 1))[family]
    rows["full"] = times > 1
    rows["ask"] = lead & (kinds > 1) & (alone > 0)
    rows["times"] = times
    return rows.loc[rows["full"] | rows["ask"], ["doc_id", "gram", "first", "windows", "off", "times", "full", "ask"]]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the contexts that must be looked at."""
    for batch in batches:
        for at in range(0, len(batch), 200):
            out = []
            for doc, text, asked in batch.iloc[at : at + 200][["doc_id", "text", "asked"]].itertuples(index=False):
                data = text.encode()
                for x in asked:
                    out.append((doc, x["gram"], x["first"], x["windows"], x["off"], x["times"], data[x["first"] : x["first"] + x["windows"] + WINDOW - 1]))
            yield pd.DataFrame(out, columns=["doc_id", "gram", "first", "windows", "off", "times", "data"])


def repeated_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """For each of some distinct strings, which of its windows also start elsewhere in them."""
    sizes = np.array([len(x) for x in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text = joined.astype(np.int64) + 2
    text[begin + sizes] = 1  # between the strings
    text = np.append(text, 0)
    order = suffix_array(text)
    left = np.full(len(text), -1)
    for b, s in zip(begin.tolist(), sizes.tolist()):
        left[b : b + s] = np.arange(s, 0, -1)
    inside = order[left[order] >= WINDOW]  # suffixes that hold a whole window; order is kept
    windows = Rolling(joined.tobytes()).all(WINDOW)[inside]
    same = windows[1:] == windows[:-1]
    marked = np.zeros(len(text), bool)
    marked[inside] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return [marked[b : b + s - WINDOW + 1] for b, s in zip(begin.tolist(), sizes.tolist())]


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans (doc_id, begin, end) of the repeated windows of contexts that stand only once as a whole."""
    rows = rows.reset_index(drop=True)
    buffer = b"".join(rows["data"])
    rolling = Rolling(buffer)
    count = rows["windows"].to_numpy(np.int64)
    origin = np.concatenate([[0], np.cumsum(count + WINDOW - 1)[:-1]])
    row = np.repeat(np.arange(len(rows)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    off = rows["off"].to_numpy(np.int64)
    offset = off[row] - nth
    block = offset // PIECE
    lead = np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
    starts = np.flatnonzero(lead)
    length = np.diff(starts, append=len(row))
    row, block, first, top = row[starts], block[starts], origin[row[starts]] + nth[starts], offset[starts]
    core = origin[row] + off[row] - block * PIECE
    gram = rows["gram"].to_numpy().view(np.uint64)[row]
    family = mix(rolling.of(core, core + WINDOW - PIECE + 1) ^ mix(gram + block.astype(np.uint64)))
    content = mix(rolling.of(first, first + length + WINDOW - 1) ^ mix(family + top.astype(np.uint64)))
    _, family, held = np.unique(family, return_inverse=True, return_counts=True)
    _, one, content, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
    equal = times[content] > 1
    kinds = np.bincount(family[one], minlength=len(held))
    open_family = np.bincount(family, weights=(rows["times"].to_numpy()[row] == 1) & ~equal, minlength=len(held)) > 0
    # Contents to sort: of families with several of them, of which one is still open.
    asked = one[(kinds[family[one]] > 1) & open_family[family[one]]]
    asked = asked[np.argsort(family[asked], kind="stable")]
    marks: dict[int, np.ndarray] = {}
    lot, symbols = [], 0
    for i, p in enumerate(asked.tolist()):
        lot.append(p)
        symbols += int(length[p]) + WINDOW
        last = i + 1 == len(asked) or family[asked[i + 1]] != family[p]
        if last and (symbols >= TEXT_SYMBOLS or i + 1 == len(asked)):
            found = repeated_windows([buffer[first[x] : first[x] + length[x] + WINDOW - 1] for x in lot])
            marks.update((int(content[x]), m) for x, m in zip(lot, found))
            lot, symbols = [], 0
    doc, begin, single = rows["doc_id"].to_numpy(), rows["first"].to_numpy(np.int64), rows["times"].to_numpy() == 1
    out = []
    for p in np.flatnonzero(single[row]).tolist():
        at = begin[row[p]] + first[p] - origin[row[p]]
        if equal[p]:
            out.append((doc[row[p]], at, at + length[p] + WINDOW - 1))
        elif (mark := marks.get(int(content[p]))) is not None and mark.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]])))
            out += [(doc[row[p]], at + a, at + b + WINDOW - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return pd.DataFrame(out, columns=["doc_id", "begin", "end"], dtype="int64")


def _merged(doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that cover the windows at these places."""
    order = np.lexsort((begin, doc))
    doc, begin = doc[order], begin[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + WINDOW)])[: len(doc)]
    starts = np.flatnonzero(first)
    ends = begin[np.append(starts[1:], len(begin)) - 1] + WINDOW if len(begin) else begin
    return doc[starts], begin[starts], ends


def _totals(windows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by window, the first of each window in it, and how often each is there."""
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    lead = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
    number = np.cumsum(lead) - 1
    return order, lead, np.bincount(number, weights=times[order]).astype(np.int64)[number] if len(ranked) else times


_DEALT = "part int, windows binary, docs binary, begins binary, times binary"


def _windows(ranges: int):
    """Window hashes of some contexts by range, as packed arrays.

    A window that some of these contexts share is covered in all of them, which
    goes as spans of its own behind the ranges; one of them goes on with their
    number, so a window that a third of all documents hold is sent once for each
    lot of contexts.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                own = [Rolling(x).all(WINDOW) for x in part["data"]]
                sizes = np.array([len(x) for x in own])
                nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                windows = np.concatenate(own)
                doc = np.repeat(part["doc_id"].to_numpy(np.int64), sizes)
                begin = np.repeat(part["first"].to_numpy(np.int64), sizes) + nth
                order, lead, total = _totals(windows, np.repeat(part["times"].to_numpy(np.int64), sizes))
                windows, doc, begin = windows[order], doc[order], begin[order]
                spans = _merged(doc[total > 1], begin[total > 1])
                out = [(ranges + at // 2000 % ranges, b"", *(x.tobytes() for x in spans))] if len(spans[0]) else []
                windows, doc, begin, total = windows[lead], doc[lead], begin[lead], total[lead]
                place = (windows % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order], np.arange(ranges + 1))
                packed = [x[order] for x in (windows, doc, begin, total)]
                out += [(r, *(x[cuts[r] : cuts[r + 1]].tobytes() for x in packed)) for r in range(ranges) if cuts[r] < cuts[r + 1]]
                yield pd.DataFrame(out, columns=["part", "windows", "docs", "begins", "times"])

    return deal


def _counted(ranges: int):
    """Spans of the windows of a range that stand in several places."""

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        windows, doc, begin, times = (
            np.frombuffer(b"".join(rows[c]), kind)
            for c, kind in (("windows", np.uint64), ("docs", np.int64), ("begins", np.int64), ("times", np.int64))
        )
        if key[0] >= ranges:
            return pd.DataFrame({"doc_id": doc, "begin": begin, "end": times})
        order, _, total = _totals(windows, times)
        again = total > 1
        return pd.DataFrame(dict(zip(("doc_id", "begin", "end"), _merged(doc[order][again], begin[order][again]))))

    return count


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Spans (doc_id, begin, end) in bytes that together cover every repeated window of (doc_id, text)."""
    contexts = stored(texts.mapInPandas(_contexts, _CONTEXT), "contexts")
    frequent = F.broadcast(stored(frequent_grams(contexts), "grams"))
    units = max(1, contexts.count() // TASK_ANCHORS)
    reduced = contexts.mapInPandas(_collapse, _CONTEXT + ", lead boolean")
    # Contexts of one batch that equal another of it are settled there; one of each goes on.
    settled = reduced.where("times > 1 and not lead").select("doc_id", "gram", "first", "windows", "off", "times", F.lit(True).alias("full"), F.lit(False).alias("ask"))
    schema = "doc_id long, gram long, first int, windows short, off short, times int, full boolean, ask boolean"
    usual = (
        reduced.where("lead").join(frequent, "gram", "left_anti").drop("lead").withColumn("unit", F.pmod(F.xxhash64("gram"), F.lit(units)))
        .groupBy("unit").applyInPandas(_met, schema)
    )
    # A frequent anchor may have any number of contexts; their numbers are summed by context instead.
    held = reduced.where("lead").drop("lead").join(frequent, "gram")
    sums = held.groupBy("gram", "context").agg(F.sum("times").cast("int").alias("times"), F.min(F.struct("doc_id", "first")).alias("lead"))
    hot = held.drop("times").join(sums, ["gram", "context"]).select(
        "doc_id", "gram", "first", "windows", "off", "times", (F.col("times") > 1).alias("full"),
        (F.struct("doc_id", "first") == F.col("lead")).alias("ask"),
    )
    found = stored(usual.unionByName(hot).unionByName(settled), "met")
    asked = found.where("ask").groupBy("doc_id").agg(F.collect_list(F.struct("gram", "first", "windows", "off", "times")).alias("asked"))
    schema = "doc_id long, gram long, first int, windows short, off short, times int, data binary"
    looked = stored(texts.join(asked.hint("merge"), "doc_id").mapInPandas(_cut, schema), "looked")
    size = looked.agg(F.sum(F.length("data"))).first()[0] or 0
    pieces = (
        looked.join(frequent, "gram", "left_anti").withColumn("unit", F.pmod(F.xxhash64("gram"), F.lit(max(1, size // TASK_BYTES))))
        .groupBy("unit").applyInPandas(_settled, "doc_id long, begin long, end long")
    )
    hot = looked.join(frequent, "gram")
    ranges = max(1, (hot.agg(F.sum("windows")).first()[0] or 0) // TASK_ANCHORS)
    single = (
        hot.select("doc_id", "first", "times", "data").mapInPandas(_windows(ranges), _DEALT)
        .groupBy("part").applyInPandas(_counted(ranges), "doc_id long, begin long, end long")
    )
    full = found.where("full").select("doc_id", F.col("first").cast("long").alias("begin"), (F.col("first") + F.col("windows") + (WINDOW - 1)).cast("long").alias("end"))
    return full.union(pieces).union(single)


def _kept(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and the bytes that are left."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    starts = np.flatnonzero(new)
    runs = list(zip(begin[starts].tolist(), reach[np.append(starts[1:], len(begin)) - 1].tolist()))
    edges = [0, *(x for run in runs for x in run), len(data)]
    return runs, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    A null or empty text has no bytes.  Every row is a document of its own: rows
    that repeat an id and text repeat all its windows, and rows without an id or
    with an id of other rows are cleaned like all others.  Other columns are not
    looked at, and an empty table gives no rows.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(texts.select(F.col("key").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("key")).agg(
        F.collect_set(F.struct("begin", "end")).alias("spans")
    )

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, own in zip(batch["text"], batch["spans"]):
                data, runs = text.encode(), []
                kept = data
                if own is not None and len(own):
                    pairs = np.array([(x["begin"], x["end"]) for x in own], np.int64)
                    runs, kept = _kept(data, pairs[:, 0], pairs[:, 1])
                out.append((len(data), len(data) - len(kept), len(runs), kept))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    return texts.join(spans.hint("merge"), "key", "left").select("doc_id", "text", "spans").mapInPandas(
        apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def repeat_digests(cleaned: DataFrame) -> DataFrame:
    """The same with a digest in place of the bytes that are left."""
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
