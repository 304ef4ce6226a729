"""Quality rules on repetition, by a suffix array over the words of each document.

Suffixes of a block of documents are sorted by prefix doubling; a suffix begins
with its document, so no order and no repeat crosses from one to the next.
Longest common prefixes of neighbours then give, for every word, the longest
repeat that starts there.  Their spans are united per document.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import whole

#: Words sorted together; a longer document is a block of its own.
BLOCK_WORDS = 150_000
_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A document is kept while none of these is exceeded."""

    #: Share of the words inside repeats of ``repeat_words`` words or more.
    repeat_words: int = 8
    covered: float = 0.3
    #: Longest repeat, as a share of the words, of documents with ``long_words`` words or more.
    longest: float = 0.3
    long_words: int = 50
    #: Lines equal to an earlier one, as a share of the lines with a word.
    duplicate_lines: float = 0.3
    #: Symbols for each word.
    symbols: float = 1.0


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length in words of the longest string that starts at each position and again elsewhere in its document.

    ``words`` holds a number for each pair of document and word, ``ends`` the
    end of each position's document.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.flatnonzero(np.diff(words[order], prepend=-1))
    sizes = np.diff(new, append=n)
    starts = np.repeat(new, sizes)
    rank = np.empty(n, np.int64)
    rank[order] = starts
    levels, length = [], 1
    active = order[np.repeat(sizes, sizes) > 1]
    while len(active):
        levels.append(rank)
        ahead = active + length
        inside = ahead < ends[active]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        bucket = rank[active]
        key = bucket * (n + 2) + second
        by = np.argsort(key, kind="stable")
        active, bucket, key = active[by], bucket[by], key[by]
        index = np.arange(len(active))
        place = bucket + index - np.maximum.accumulate(np.where(np.diff(bucket, prepend=-1) != 0, index, 0))
        order[place] = active
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(first, append=len(active))
        rank = rank.copy()
        rank[active] = np.repeat(place[first], sizes)
        active = active[np.repeat(sizes, sizes) > 1]
        length *= 2
    left, right = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    if levels:
        pairs = np.flatnonzero(levels[0][left] == levels[0][right])
        a, b, end = left[pairs], right[pairs], ends[left[pairs]]
        for k in range(len(levels) - 1, -1, -1):
            near = np.flatnonzero(np.maximum(a, b) < end)
            same = near[levels[k][a[near]] == levels[k][b[near]]]
            a[same] += 1 << k
            b[same] += 1 << k
        common[pairs] = a - left[pairs]
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def covered_words(longest: np.ndarray, least: int, ends: np.ndarray, whole_repeat: bool) -> np.ndarray:
    """Marks the words in the union of repeats of at least ``least`` words, or of their windows of just that many."""
    starts = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + (longest[starts] if whole_repeat else least), -1)
    return np.cumsum(change[:-1]) > 0


def _measure(texts: list[str], repeat_words: int) -> pd.DataFrame:
    """Counts of a block of texts."""
    numbers: defaultdict = defaultdict(itertools.count().__next__)
    codes, sizes, rows = [], [], []
    for text in texts:
        words = text.encode().split()  # of bytes, so at ASCII white space only
        codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
        lines = [x for x in text.split("\n") if x.strip(_SPACES)]
        rows.append((
            len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)),
            len(lines),
        ))
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"], dtype="int64")
    sizes = np.array(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    longest = longest_repeats(doc * max(1, len(numbers)) + np.concatenate(codes), ends)
    count = lambda marked: np.bincount(doc, weights=marked, minlength=len(texts)).astype(np.int64)
    out["n_repeat_words"] = count(covered_words(longest, 8, ends, whole_repeat=False))
    out["n_covered_words"] = count(covered_words(longest, repeat_words, ends, whole_repeat=True))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc, longest)
    out["longest_repeat"] = most
    return out


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in blocks of about the same number of characters."""
    block, chars = [], 0
    for text in texts:
        if block and chars + len(text) > 6 * BLOCK_WORDS:
            yield block
            block, chars = [], 0
        block.append(text)
        chars += len(text)
    if block:
        yield block


def judged(texts: list[str], limits: Limits) -> pd.DataFrame:
    """Counts and verdicts of some texts."""
    out = pd.concat([_measure(x, limits.repeat_words) for x in _blocks(texts)], ignore_index=True)
    words = out["n_words"]
    out["base_failed"] = (words < 20) | (100 * out["n_repeat_words"] > 30 * words)
    out["kept"] = ~(
        out["base_failed"]
        | (out["n_covered_words"] > limits.covered * words)
        | ((words >= limits.long_words) & (out["longest_repeat"] > limits.longest * words))
        | (out["n_dup_lines"] > limits.duplicate_lines * out["n_lines"])
        | (out["n_symbols"] > limits.symbols * words)
    )
    return out


def quality_rules(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, its counts, base_failed and kept.

    A null or empty text has no words and fails.  Rows are judged one by one:
    repeated rows repeat their verdict, other columns are not looked at, and an
    empty table gives no rows.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = judged(batch["text"].tolist(), limits)
                out.insert(0, "doc_id", batch["doc_id"].to_numpy())
                yield out

    rows = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_covered_words", "longest_repeat")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in counts)
    return rows.mapInPandas(judge, schema + ", base_failed boolean, kept boolean")


def passing(df: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns; decided where the row is read, without a join."""

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[judged(batch[text_col].fillna("").tolist(), limits)["kept"].to_numpy()]

    return df.mapInPandas(select, df.schema)
