"""N-gram Jaccard join by T-occurrence search with DivideSkip.

1. Every document becomes its set of shingles; documents with equal sets are
   one class from here on.
2. Linked sets share many of their smallest hashes.  Those prefixes are dealt
   by hash; a class that shares too few with other classes has no partner.
3. What is left is routed by keys of which linked sets share one.  Classes
   connected by keys form a cluster, and clusters larger than a block are cut
   into blocks.
4. In each block an inverted index is searched: the short lists of a query are
   heap-merged, the long ones probed by binary search, and sets that reach the
   required overlap are linked.  Sets already connected are not compared again.
5. Components of the links give the result.  No pair is dropped: in a large
   cluster, what its main component has not met is compared in a second round.
   Linked sets also share one of their rarest hashes, so sets that have only the
   words of a template in common do not meet there.  A group of sets behind such
   a hash is compared by pairs of blocks if it is larger than a block.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.graph import components
from siftline.llm.shingles import Overlap, WordHashes, part_keys, shingle_set
from siftline.llm.tables import discard, stored, whole

#: Hashes that one task holds at a time, for prefixes and for indexed sets.
TASK_HASHES = 400_000
#: Sets whose prefixes are dealt together.
BATCH_SETS = 2500
#: Classes in a block, besides the limit on hashes.
BLOCK_SETS = 1000
#: DivideSkip's weight of probing a list against merging it.
MU = 0.002
#: Members of a large cluster that are searched for in each of its blocks, so that the blocks' components meet.
PIVOTS = 8


def _sets(df: DataFrame, size: int, overlap: Overlap) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null: empty set) and its prefix."""

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = shingle_set(text, size, hashes)
                n = len(own)
                rows.append((n, xxhash.xxh3_128_digest(own.tobytes()) if n else None, own[: int(overlap.prefix(n))].tobytes() if n else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "prefix"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return df.mapInPandas(shingle, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_shingles long, digest binary, prefix binary")


def _dealt(ranges: int):
    """Prefix hashes by range: 32 bits of each hash beside the digest of its set, as packed arrays.

    A hash that several sets of a batch have is counted for all of them here and
    sent on with one of them, so a hash that a third of all sets have is sent
    once for each batch.  Those counts go as ranges of their own behind the rest.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + BATCH_SETS] for b in batches for at in range(0, len(b), BATCH_SETS)):
            own = [np.frombuffer(x, np.uint64) for x in batch["prefix"]]
            hashes = np.concatenate(own)
            owners = np.repeat(batch["owner"].to_numpy(np.int64), [len(x) for x in own])
            hashes, owners, common = _common(hashes, owners)
            owner, count = np.unique(owners[common], return_counts=True)
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else common
            hashes, owners = hashes[first], owners[first]
            part = (hashes % np.uint64(ranges)).astype(np.int64)
            short = ((hashes // np.uint64(ranges)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(ranges + 1))
            short, owners = short[order], owners[order]
            if len(owner):
                counted = ranges + int(owner[0]) % ranges
                yield pd.DataFrame([(counted, count.astype(np.uint32).tobytes(), owner.tobytes())], columns=["part", "hashes", "owners"])
            for lot in range(0, ranges, 256):
                rows = [
                    (r, short[cuts[r] : cuts[r + 1]].tobytes(), owners[cuts[r] : cuts[r + 1]].tobytes())
                    for r in range(lot, min(lot + 256, ranges)) if cuts[r] < cuts[r + 1]
                ]
                yield pd.DataFrame(rows, columns=["part", "hashes", "owners"])

    return deal


def _common(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by hash and owner, and which of them have a hash that another owner has too."""
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])[: len(hashes)]
    hashes, owners = hashes[once], owners[once]
    near = hashes[1:] == hashes[:-1]
    return hashes, owners, (np.concatenate([[False], near]) | np.concatenate([near, [False]]))[: len(hashes)]


def _shared(ranges: int):
    """How many hashes of a range each set shares with another one, packed by blocks of sets."""

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(rows["hashes"]), np.uint32)
        owners = np.frombuffer(b"".join(rows["owners"]), np.int64)
        times = hashes.astype(np.int64)
        if key[0] < ranges:
            _, owners, common = _common(hashes, owners)
            owners, times = np.unique(owners[common], return_counts=True)
        block = owners % ranges
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(ranges + 1))
        owners, times = owners[order], times[order].astype(np.int64)
        out = [(b, owners[cuts[b] : cuts[b + 1]].tobytes(), times[cuts[b] : cuts[b + 1]].tobytes()) for b in range(ranges) if cuts[b] < cuts[b + 1]]
        return pd.DataFrame(out, columns=["block", "owners", "times"])

    return count


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Shared hashes of each set of a block over all ranges."""
    owners, at = np.unique(np.frombuffer(b"".join(rows["owners"]), np.int64), return_inverse=True)
    total = np.zeros(len(owners), np.int64)
    np.add.at(total, at, np.frombuffer(b"".join(rows["times"]), np.int64))
    return pd.DataFrame({"owner": owners, "shared": total})


class Index:
    """Inverted lists of a block's sets, searched by T-occurrence."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        self.hashes, token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(token, kind="stable")  # each list is sorted by set
        self.lists = doc[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(self.hashes)))])
        self.codes = token[order] * np.int64(len(sets)) + self.lists

    def search(self, query: np.ndarray, overlap: Overlap, wanted: np.ndarray) -> Iterator[int]:
        """Sets of ``wanted`` (a mask the caller may narrow meanwhile) whose overlap with the query is large enough."""
        n = len(query)
        at = np.minimum(np.searchsorted(self.hashes, query), len(self.hashes) - 1)
        tokens = at[self.hashes[at] == query]
        least = int(overlap.least_size(n))
        if len(tokens) < least:
            return
        tokens = tokens[np.argsort(self.begin[tokens + 1] - self.begin[tokens], kind="stable")]
        longest = int(self.begin[tokens[-1] + 1] - self.begin[tokens[-1]])
        long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
        short, probed = tokens[: len(tokens) - long], tokens[len(tokens) - long :]
        merged = heapq.merge(*(self.lists[self.begin[t] : self.begin[t + 1]].tolist() for t in short))
        seen = [(doc, sum(1 for _ in same)) for doc, same in itertools.groupby(merged)]
        seen = [(doc, count) for doc, count in seen if count >= least - long and wanted[doc]]
        for lot in range(0, len(seen), 64):
            docs, counts = (np.array(x) for x in zip(*seen[lot : lot + 64]))
            codes = probed[:, None] * np.int64(len(self.sizes)) + docs[None, :]
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            counts = counts + (self.codes[place] == codes).sum(axis=0)
            for doc in docs[counts >= overlap.least_common(n, self.sizes[docs])].tolist():
                if wanted[doc]:
                    yield doc


def block_links(
    ids: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, queries: np.ndarray, overlap: Overlap, sides: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that connect the sets of a block as all its links with a query would; ``groups`` names what is connected already.

    With ``sides`` only sets of different sides are compared.
    """
    index = Index(sets)
    _, label = np.unique(groups, return_inverse=True)
    out = []
    for q in np.flatnonzero(queries).tolist():
        across = np.ones(len(sets), bool) if sides is None else sides != sides[q]
        wanted = across & (label != label[q])
        if not wanted.any():
            continue
        for doc in index.search(sets[q], overlap, wanted):
            out.append((int(ids[q]), int(ids[doc])))
            label[label == label[doc]] = label[q]
            np.logical_and(across, label != label[q], out=wanted)
    return out


def _searched(overlap: Overlap):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        # Of a set that is in its block both by itself and as a guest, the row that asks is the one to keep.
        rows = rows.sort_values(["cluster", "class_id", "query"], ascending=[True, True, False]).drop_duplicates(["cluster", "class_id", "hashes"])
        for _, own in rows.groupby("cluster", sort=False):
            sets = [np.frombuffer(x, np.uint64) for x in own["hashes"]]
            sides = own["side"].to_numpy() if own["side"].nunique() > 1 else None
            out += block_links(own["class_id"].to_numpy(), sets, own["known"].to_numpy(), own["query"].to_numpy(bool), overlap, sides)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return search


def _search(rows: DataFrame, overlap: Overlap) -> DataFrame:
    """Links found in each unit of rows (unit, cluster, class_id, hashes, known, query, side)."""
    return rows.groupBy("unit").applyInPandas(_searched(overlap), "a long, b long")


def _rarest(overlap: Overlap):
    """The hashes of each set of a block of which linked sets share one, those that few guests hold first.

    All blocks of a cluster have the same guests, so one order serves them all.
    """

    def rarest(rows: pd.DataFrame) -> pd.DataFrame:
        guests = [np.frombuffer(x, np.uint64) for x in rows.loc[rows["guest"], "hashes"]]
        held, times = np.unique(np.concatenate([np.zeros(1, np.uint64), *guests]), return_counts=True)
        own = rows.loc[~rows["guest"]]
        tokens = []
        for data in own["hashes"]:
            hashes = np.frombuffer(data, np.uint64)
            at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
            seen = np.where(held[at] == hashes, times[at], 0)
            tokens.append(hashes[np.lexsort((hashes, seen))[: len(hashes) - int(overlap.least_size(len(hashes))) + 1]])
        count = [len(x) for x in tokens]
        columns = {c: np.repeat(own[c].to_numpy(), count) for c in ("cluster", "class_id", "known", "asks", "n")}
        return pd.DataFrame({"token": np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64), **columns})

    return rarest


def _blocks(total: str, sets: str) -> Column:
    return F.ceil(F.greatest(F.col(total) / TASK_HASHES, F.col(sets) / BLOCK_SETS)).cast("int")


def _rare_groups(apart: DataFrame, overlap: Overlap) -> DataFrame:
    """Groups (meeting, class_id) of sets with a rare hash in common, of different components and at least one of them asking.

    A group is all that hold some hash.  Hashes with the same holders, such as
    those of a passage, are one group, so a set goes into few of them however
    long it is.
    """
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    columns = ("cluster", "class_id", "hashes", "known", "asks", "n")
    guests = apart.where(F.pmod(F.xxhash64("class_id", F.lit(2)), 4 * F.col("blocks")) == 0)
    rows = apart.select(*columns, block.alias("block"), F.lit(False).alias("guest")).union(
        guests.select(*columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.lit(True))
    )
    rare = stored(
        rows.groupBy("cluster", "block").applyInPandas(_rarest(overlap), "token long, cluster long, class_id long, known long, asks boolean, n long"),
        "rare",
    )
    lists = (
        rare.groupBy("cluster", "token")
        .agg(F.min("known").alias("low"), F.max("known").alias("high"), F.max("asks").alias("asks"), F.count("*").alias("times"),
             F.bit_xor(F.xxhash64("class_id")).alias("held"))
        .where("asks and low != high")
        # Two lists that met here by chance would only be one larger group.
        .select("cluster", "token", F.xxhash64("cluster", "held", "times").alias("meeting"))
    )
    return _together(rare.join(lists, ["cluster", "token"]).select("meeting", "class_id", "n").distinct())


def _together(groups: DataFrame) -> DataFrame:
    """Groups with the same set as their first by a hash become one, which holds all that meet in any of them.

    Near copies meet behind many hashes, each time in almost the same group, and
    nearly equal groups mostly have the same first set.  So a set is sent to few
    groups instead of one for each of its hashes.  What becomes one group is
    never more than the groups of one set.
    """
    for salt in range(2):
        first = groups.groupBy("meeting").agg(F.min_by("class_id", F.xxhash64("class_id", F.lit(salt))).alias("first"))
        groups = groups.join(first, "meeting").select(F.col("first").alias("meeting"), "class_id", "n").distinct()
    return groups


def _met_again(apart: DataFrame, overlap: Overlap) -> DataFrame:
    """Links of the sets that ask with sets of other components; each task has two blocks of a group at most."""
    groups = stored(_rare_groups(apart, overlap), "groups")
    sizes = stored(groups.groupBy("meeting").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).withColumn("blocks", _blocks("total", "sets")), "meetings")
    units = max(1, (sizes.agg(F.sum("total")).first()[0] or 0) // TASK_HASHES)
    members = groups.select("meeting", "class_id").join(sizes, "meeting").join(apart.select("class_id", "hashes", "known", "asks"), "class_id")
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    columns = (F.col("meeting").alias("cluster"), "class_id", "hashes", "known", F.col("asks").alias("query"))
    small = members.where("blocks = 1").select(F.pmod(F.xxhash64("meeting"), F.lit(units)).alias("unit"), *columns, F.lit(0).alias("side"))
    # A block meets itself in a unit of its own, and every other block in a unit with that one.
    large = members.where("blocks > 1").withColumn("side", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(F.xxhash64("meeting", F.least("side", "other"), F.greatest("side", "other")).alias("unit"), *columns, "side")
    return _search(small.union(large), overlap)


def _links(sets: DataFrame, clusters: DataFrame, overlap: Overlap) -> DataFrame:
    """Links between the sets of each cluster, enough to connect all that are linked; ``sets`` is read once and goes."""
    held = stored(sets.join(clusters, "class_id"), "members")
    discard(sets)
    sizes = held.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).withColumn("blocks", _blocks("total", "sets"))
    sizes = stored(sizes, "sizes")
    total = sizes.agg(F.sum("total")).first()[0] or 0
    units = max(1, total // TASK_HASHES)
    members = held.join(sizes, "cluster")
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks"))
    unit_of = lambda block: F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(units))).otherwise(
        F.xxhash64("cluster", block)
    )
    columns = ("cluster", "class_id", "hashes", F.col("class_id").alias("known"), F.lit(True).alias("query"), F.lit(0).alias("side"))
    own = members.select(unit_of(block.cast("long")).alias("unit"), *columns)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    pivots = members.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("class_id", F.lit(1)), F.ceil(F.col("sets") / PIVOTS)) == 0))
    guests = pivots.select("blocks", *columns, every).withColumn("unit", unit_of(F.col("block").cast("long"))).select(own.columns)
    links = stored(_search(own.union(guests), overlap), "first_links")
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        discard(held)
        return links
    # In a large cluster, what its largest component has not met yet asks again; clusters in one piece are done.
    apart = members.where("blocks > 1").join(components(links).withColumnRenamed("node", "class_id"), "class_id", "left").withColumn(
        "known", F.coalesce("component", "class_id")
    )
    parts = apart.groupBy("cluster", "known").agg(F.count("*").alias("held"))
    main = parts.groupBy("cluster").agg(F.max_by("known", F.struct("held", "known")).alias("main"), F.count("*").alias("pieces")).where("pieces > 1")
    apart = stored(
        apart.join(main, "cluster").select("cluster", "class_id", "hashes", "n", "blocks", "known", (F.col("known") != F.col("main")).alias("asks")), "apart"
    )
    discard(held)
    if apart.isEmpty():
        return links
    second = stored(_met_again(apart, overlap), "second_links")
    discard(apart)
    return links.union(second)


def jaccard_components(
    df: DataFrame, size: int = 3, share: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row: doc_id, n_shingles, class_id and component_id.

    Two documents link when intersection / union of their sets of ``size``-word
    shingles is at least ``share``.  ``class_id`` is the smallest id with the
    same set, ``component_id`` the smallest id reachable by links.  Null, empty
    and blank texts have no set and stand alone.  Rows that repeat an id are one
    document, linked by any of its texts.  Rows without an id take the component
    of their set but link nothing.  Other columns are not looked at, and an empty
    table gives no rows.
    """
    overlap = Overlap(share)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    prefixes = stored(_sets(texts, size, overlap), "shingles")
    documents = stored(prefixes.drop("prefix"), "documents")
    full = prefixes.where("n_shingles > 0")
    owner = F.xxhash64("digest").alias("owner")
    classes = documents.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"))
    total = full.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(1, int(total * float(overlap.prefix(1000)) / 1000) // TASK_HASHES)
    # Copies have one owner, so they do not count as partners of each other.
    shared = (
        full.select(owner, "prefix").mapInPandas(_dealt(ranges), "part int, hashes binary, owners binary")
        .groupBy("part").applyInPandas(_shared(ranges), "block int, owners binary, times binary")
        .groupBy("block").applyInPandas(_summed, "owner long, shared long")
    )
    least = F.ceil(F.col("n") * share.numerator / share.denominator)
    needed = F.greatest(F.lit(1), F.floor(least * 3 / 20))
    possible = stored(
        classes.withColumn("owner", owner).join(shared, "owner").where((F.col("shared") >= needed) & F.col("class_id").isNotNull()).select("class_id"),
        "possible",
    )
    discard(prefixes)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, size, hashes) for text in batch["text"]]
            yield pd.DataFrame({"class_id": batch["doc_id"], "n": [len(x) for x in sets], "hashes": [x.tobytes() for x in sets]})

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [part_keys(np.frombuffer(x, np.uint64), overlap) for x in batch["hashes"]]
            yield pd.DataFrame({"key": np.concatenate([np.zeros(0, np.int64), *own]), "class_id": np.repeat(batch["class_id"].to_numpy(), [len(x) for x in own])})

    sets = stored(
        texts.join(possible.hint("merge"), texts["doc_id"] == possible["class_id"], "left_semi").mapInPandas(again, "class_id long, n long, hashes binary"),
        "sets",
    )
    routed = stored(sets.select("class_id", "hashes").mapInPandas(keys, "key long, class_id long"), "routed")
    met = routed.groupBy("key").agg(F.count("*").alias("times"), F.min("class_id").alias("b")).where("times > 1")
    edges = routed.join(met, "key").select(F.col("class_id").alias("a"), "b").where("a != b").distinct()
    clusters = components(edges).select(F.col("node").alias("class_id"), F.col("component").alias("cluster"))
    discard(routed)
    linked = components(_links(sets, clusters, overlap))
    named = classes.join(linked, classes["class_id"] == linked["node"], "left").select(
        F.col("digest").alias("_digest"), "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    return documents.join(named, documents["digest"] == named["_digest"], "left").select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(df: DataFrame, size: int = 5, share: Fraction = Fraction(8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the smallest id of their component, with all their columns; rows without an id stay."""
    found = jaccard_components(df, size, share, id_col, text_col)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone.hint("merge"), df[id_col] == gone["_gone"], "left_anti")
