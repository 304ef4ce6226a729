"""Grouping of spelling variants by PartEnum signatures of letter multisets.

A word is the multiset of its letters, a binary vector over pairs of a letter
and its number.  A replaced letter changes two parts of that vector, an added
or lost one a single part.  The letters are dealt into ``PARTS`` classes; what
is left of a vector after taking out as many classes as may have changed is a
signature, and near words share one exactly.  Since the words also agree on
their first or on their last half, that half belongs to the key, which keeps
keys rare in any vocabulary.  Equal keys are joined and verified.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import stored, whole

#: Letters of a word after lower-casing A-Z, as they follow one another in Unicode.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
#: Letter classes for words of equal length, of which two may differ, and for words one letter apart in length.
PARTS = {2: 5, 1: 3}


def spelled_words(
    df: DataFrame, damage: int = 199, min_letters: int = 6, min_count: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts.

    Words are runs of letters with A-Z lowered.  An occurrence whose checksum
    with its document's id is a multiple of ``damage`` loses one letter.
    """
    runs = F.regexp_extract_all(whole(text_col), F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = F.transform(runs, lambda r: F.translate(r, upper, lower))
    mark = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    each = df.select(mark.alias("mark"), F.explode(lowered).alias("run"))
    check = F.crc32(F.encode(F.concat("mark", "run"), "UTF-8"))
    at = (check % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = each.where(F.length("run") >= min_letters).select(F.when(check % damage == 0, damaged).otherwise(F.col("run")).alias("word"))
    return (
        words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    )


def _signatures(word: Column, differing: int) -> list[Column]:
    """The sorted letters of the classes left after taking out each choice of ``differing`` classes."""
    parts = PARTS[differing]
    classes = [[c for c in LETTERS if ord(c) % parts == p] for p in range(parts)]
    out = []
    for gone in combinations(range(parts), differing):
        kept = F.translate(word, "".join(c for p in gone for c in classes[p]), "")
        out.append(F.array_join(F.array_sort(F.split(kept, "")), ""))
    return out


def _keys(words: DataFrame, shorter: Column, differing: int) -> DataFrame:
    """``word`` with a key for each half and signature; ``shorter`` is the length of the shorter word of a pair."""
    half = F.floor(shorter / 2).cast("int")
    halves = [F.substring("word", F.lit(1), half), F.substring("word", F.length("word") - half + 1, half)]
    found = words.select("word", *(h.alias(f"h{i}") for i, h in enumerate(halves)), *(
        s.alias(f"s{i}") for i, s in enumerate(_signatures(F.col("word"), differing))
    ), shorter.alias("shorter"))
    count = len(list(combinations(range(PARTS[differing]), differing)))
    keys = [F.xxhash64("shorter", F.lit(h), F.lit(s), f"h{h}", f"s{s}") for h in range(2) for s in range(count)]
    return found.select("word", F.explode(F.array(*keys)).alias("key"))


def near_words(words: DataFrame) -> DataFrame:
    """``word`` and ``other`` for every ordered pair of distinct words that one inserted, deleted or replaced letter tells apart."""
    length = F.length("word")
    same = _keys(words, length, 2)
    equal = same.alias("a").join(same.select("key", F.col("word").alias("other")), "key").where("word < other")
    short, long = _keys(words, length, 1), _keys(words, length - 1, 1)
    apart = short.alias("a").join(long.select("key", F.col("word").alias("other")), "key").where(F.length("other") == length + 1)
    pairs = equal.select("word", "other").union(apart.select("word", "other"))
    near = stored(pairs.where(F.levenshtein("word", "other", 1) == 1).distinct(), "near-words")
    return near.union(near.select("other", "word"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every word with a form; counts grow fivefold at each step, so chains are short."""
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("then"))
        steps = stored(
            steps.join(further, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")),
            "roots",
        )
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")


def spelling_variants(
    df: DataFrame, times: int = 5, damage: int = 199, min_letters: int = 6, min_count: int = 5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word (the smallest of equally
    frequent ones) if that is ``times`` as frequent or more.  Null texts count
    as empty, a missing id as an empty one in the checksum; rows that repeat
    count as often as they occur.  An empty table gives no rows.
    """
    words = stored(spelled_words(df, damage, min_letters, min_count, id_col, text_col), "words")
    counted = near_words(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other"))).alias("best")
    )
    with_best = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(-F.col("best.n") >= times * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.n")).alias("n"))).alias("best"),
        ),
        "forms",
    )
    forms = with_best.select("word", F.col("best.form").alias("form"), "n", "n_near", F.col("best.n").alias("form_n"))
    return forms.join(_roots(forms.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
