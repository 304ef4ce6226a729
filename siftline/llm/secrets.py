"""Secret scan: all rules in one byte pass of a combined automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.automata import Scanner
from siftline.llm.tables import whole


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: What a match must also satisfy; a failing match is dropped and still takes its place.
    holds: Callable[[bytes], bool]


def _long(least: int) -> Callable[[bytes], bool]:
    return lambda match: len(match) >= least


def _assigned(match: bytes) -> bool:
    """Whether the assigned value has 12 bytes or more."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 12


def _mixed(match: bytes) -> bool:
    """Whether what follows the prefix has digits and letters, as random keys do."""
    return any(x in b"0123456789" for x in match[4:]) and match[4:].lower() != match[4:].upper()


#: The first three kinds are the base; a bounded count before an open end keeps the automaton small.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", _assigned),
    Rule("access", r"AKIA[A-Z0-9]+", _long(18)),
    Rule("hex", r"[0-9a-f]{16,}", _long(16)),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", lambda m: len(m) >= 40 and _mixed(m)),
    Rule("slack", r"xox[abps]\-[A-Za-z0-9\-]+", lambda m: len(m) >= 20 and _mixed(m)),
    Rule("payment", r"sk_live_[A-Za-z0-9]+", lambda m: len(m) >= 24),
    Rule("pem", r"\-\-\-\-\-BEGIN [A-Z ]*PRIVATE KEY\-\-\-\-\-", _long(1)),
)
BASE = 3


@lru_cache(1)
def scanner() -> Scanner:
    """Compiled once per worker process."""
    return Scanner([x.pattern for x in RULES])


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the rules."""
    data = text.encode()
    found = [(start, rule, end) for rule, start, end in scanner().spans(data) if RULES[rule].holds(data[start:end])]
    if len(data) != len(text):
        points = lambda at: len(data[:at].decode())  # noqa: E731  matches begin and end at ASCII bytes
        found = [(points(start), rule, points(end)) for start, rule, end in found]
    return [(RULES[rule].kind, start, end) for start, rule, end in sorted(found)]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and secrets, an array of (kind, start, end, secret) in code points.

    Null and empty texts have none.  Rows are scanned one by one: repeated rows
    repeat their spans, other columns are not looked at, and an empty table
    gives no rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[(k, a, b, text[a:b]) for k, a, b in secret_spans(text)] for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "secrets": found})

    rows = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInPandas(
        scan,
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, secrets array<struct<kind:string,start:int,end:int,secret:string>>",
    )


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    base = F.filter("secrets", lambda x: x["kind"].isin([r.kind for r in RULES[:BASE]]))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in RULES[:BASE]),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"),
    )
