"""Windows over keys of any size.

A Spark window sends every row of a key to one task.  When a single capture
holds a third of the table that task never ends, so here the rows of a large
key are first cut into contiguous slices of bounded size:

1. a hash sample of the ordering columns gives cut points for the large keys
   only: about one for every ``rows_per_slice`` rows of the whole table, and
   never more than ``MAX_CUTS``, beyond which slices grow instead; that bounds
   everything collected or broadcast here; no task sorts more than
   ``SAMPLE_ROWS`` of the sample, which is thinned step by step where a key,
   or the whole table as one key, has more;
2. every row finds its slice by binary search, map-side;
3. rows just before a cut are also copied into the next slice ("halo"), so
   frames that look a few rows back stay exact;
4. one shuffle on (key, slice) serves all window expressions;
5. running sums add the totals of the earlier slices, which are aggregated
   map-side and are as few as the cut points.

The sample only decides where to cut; results never depend on it.  Inputs of
every size take this way; without large keys there is nothing to cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_SLICE = 1_000_000
#: Most cut points of one window: what the driver collects and every task gets.
MAX_CUTS = 50_000
MAX_LOOKUP_KEYS = 10_000
#: Sampled rows of a key that one task sorts for the cut points.
SAMPLE_ROWS = 100_000
#: One of so many rows stays when the sample of a larger key is thinned.
THINNED = 8
_SEARCH_STEPS = [1 << p for p in range(MAX_CUTS.bit_length() - 1, -1, -1)]


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only if ``df`` really has at most ``max_rows`` rows.

    Larger sides stay a shuffle join, which adaptive execution splits on skew.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def lookup_hint(df: DataFrame, keys: Sequence[str], max_keys: int = MAX_LOOKUP_KEYS):
    """Hint for a side with one short row per key: broadcast when ``df`` has few keys, a plain join otherwise."""
    few = df.select(*keys).distinct().limit(max_keys + 1).count() <= max_keys
    return F.broadcast if few else (lambda side: side)


def scalars(one_row: DataFrame) -> Column:
    """The single row of an aggregate as a struct column (a scalar subquery)."""
    return one_row.select(F.struct(*one_row.columns).alias("s")).scalar()


def _sortable(df: DataFrame, name: str) -> Column:
    """Order column in a type whose JSON text is exact."""
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.unix_date(name) if kind == "date" else F.col(name)


def _order_key(df: DataFrame, order: Sequence[str]) -> Column:
    parts = []
    for i, name in enumerate(order):
        parts += [F.col(name).isNull().alias(f"n{i}"), _sortable(df, name).alias(f"v{i}")]
    return F.struct(*parts)


def _and(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class Ordered:
    """Rows of ``df`` per ``keys`` in ascending ``order`` (nulls last).

    ``order`` must be total within a key: end it with a unique column.
    ``halo`` is how many earlier rows of the key the expressions look back at.
    A key of up to about ``rows_per_slice`` rows keeps the plain window.  An
    ``aggregated`` input costs a shuffle each time it is read, so it is
    checkpointed before it is cut.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        *,
        halo: int = 0,
        rows_per_slice: int | None = None,
        aggregated: bool = False,
    ):
        self.keys, self.order, self.halo = list(keys), list(order), halo
        self._const = not self.keys
        if self._const:
            df = df.withColumn("__one_key", F.lit(0))
            self.keys = ["__one_key"]
        self._running = 0
        self.frame = cut_lineage(df) if aggregated else df
        self.sliced = True
        self._cut(rows_per_slice or ROWS_PER_SLICE)
        self._rows = self.frame

    # -- slicing -----------------------------------------------------------

    def _points(self, sample: DataFrame, halo: int) -> DataFrame:
        """The sample with ``halo``, the place that many sampled rows before, and the ``weight`` in sampled rows of each point.

        A key whose sample exceeds a task's share is dealt by hash to tasks that each sort their part and keep every
        ``THINNED``-th row; what is kept is dealt and thinned again until a key's points fit a task.  A thinned point stands
        for ``THINNED`` of the step before, so ranks are estimates, as from any merged quantile sketch.  ``halo`` is taken
        inside a part, where at least as many rows lie between as in the whole key.
        """
        keys = self.keys
        lagged = lambda window: F.lag("start", halo).over(window) if halo else F.col("start")
        match = _and([F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
        done, left, weight = None, sample, 1
        while True:
            # keys above a task's share are fewer than the sample's rows over that share
            large = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > SAMPLE_ROWS)
            large = cut_lineage(large.select(*named, "__size"))
            large = bounded_broadcast(large)
            small = left.join(large, match, "left_anti")
            if weight == 1:
                small = small.withColumn("halo", lagged(Window.partitionBy(*keys).orderBy("start")))
            small = small.withColumn("weight", F.lit(weight))
            done = small if done is None else done.unionByName(small)
            if large.isEmpty():
                return done
            parts = F.ceil(F.col("__size") / F.lit(SAMPLE_ROWS))
            dealt = left.join(large, match).withColumn("__part", F.pmod(F.xxhash64(F.lit(weight), "start"), parts))
            window = Window.partitionBy(*keys, "__part").orderBy("start")
            dealt = dealt.withColumn("__nth", F.row_number().over(window))
            if weight == 1:
                dealt = dealt.withColumn("halo", lagged(window))
            # parts start at different places, so that their kept rows interleave
            first = F.pmod(F.col("__part"), F.lit(THINNED))
            kept = dealt.where(F.pmod(F.col("__nth") + first, F.lit(THINNED)) == 0)
            left, weight = cut_lineage(kept.select(*keys, "start", "halo")), weight * THINNED

    def _cut_points(self, rows_per_slice: int) -> list:
        """Rows (keys, JSON of slice start and halo start) in key and slice order, for the large keys only."""
        keys, halo = self.keys, self.halo
        spacing = max(halo + 1, min(max(64, 32 * halo), rows_per_slice))
        stride = max(1, rows_per_slice // spacing)
        sample = self.frame.where(F.pmod(F.xxhash64(*keys, *self.order), F.lit(stride)) == 0).select(
            *keys, _order_key(self.frame, self.order).alias("start")
        )
        sample = cut_lineage(sample)
        by_key = Window.partitionBy(*keys).orderBy("start")
        sampled = sample.count()
        if sampled < spacing:
            return []
        if sampled <= SAMPLE_ROWS:
            points = sample.withColumn("halo", F.lag("start", halo).over(by_key) if halo else F.col("start"))
            points = points.withColumn("weight", F.lit(1))
        else:
            points = self._points(sample, halo)
        # a slice keeps more points than ``halo``, so that its rows alone fill the halo of the next one
        span = F.greatest(F.lit(spacing), F.col("weight") * (halo + 1))
        nth = lambda rows: F.floor(rows * F.col("weight") / span)
        cuts = (
            points.withColumn("__rn", F.row_number().over(by_key))
            .where((nth(F.col("__rn")) > nth(F.col("__rn") - 1)) & F.col("halo").isNotNull())
        )
        self._cut_type = cuts.select(F.array(F.struct("start", "halo")).alias("c")).schema["c"].dataType
        text = F.to_json(F.struct("start", "halo"), {"ignoreNullFields": "false"})
        found = cuts.count()
        if found > MAX_CUTS:
            thin = -(-found // (MAX_CUTS // 2))
            cuts = cuts.where(nth(F.col("__rn")) % thin == 0)
        elif not found:
            return []
        return cuts.select(*keys, "__rn", text.alias("__cut")).orderBy(*keys, "__rn").collect()

    def _cut(self, rows_per_slice: int) -> None:
        """Adds __slice, __halo and __hot; without large keys the plain window stays.

        There are at most ``MAX_CUTS`` cut points.  All of them form one constant of the plan; a row only carries where the
        cut points of its key begin and how many there are.
        """
        cuts = self._cut_points(rows_per_slice)
        if not cuts:
            self.sliced = False
            return
        df, keys = self.frame, self.keys
        first: dict[tuple, int] = {}
        count: dict[tuple, int] = {}
        for i, row in enumerate(cuts):
            key = tuple(row[k] for k in keys)
            first.setdefault(key, i)
            count[key] = count.get(key, 0) + 1
        kinds = ", ".join(f"__k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
        hot = df.sparkSession.createDataFrame(
            [(*key, at, count[key]) for key, at in first.items()], f"{kinds}, __at int, __n int"
        )
        match = _and([F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        cut = df.join(F.broadcast(hot), match, "left").drop(*[f"__k{i}" for i in range(len(keys))])

        constant = F.from_json(F.lit("[" + ",".join(row["__cut"] for row in cuts) + "]"), self._cut_type)
        point = lambda i, part: F.get(constant, i)[part]
        own = F.col("__o")
        # powers of two up to the number of cuts, largest first
        width = F.length(F.bin("__n"))
        steps = F.slice(F.array(*[F.lit(s) for s in _SEARCH_STEPS]), -width, width)
        search = F.aggregate(
            steps,
            F.lit(0),
            lambda pos, step: F.when(
                (pos + step <= F.col("__n")) & (point(F.col("__at") + pos + step - 1, "start") <= own), pos + step
            ).otherwise(pos),
        )
        cut = cut.withColumn("__o", _order_key(df, self.order)).withColumn(
            "__slice", F.when(F.col("__n").isNull(), F.lit(0)).otherwise(search)
        )
        cut = cut.withColumn("__hot", F.col("__n").isNotNull())
        if self.halo:
            # the slice after this one starts at cut number __slice of the key
            follows = (F.col("__slice") < F.col("__n")) & (point(F.col("__at") + F.col("__slice"), "halo") <= own)
            here = F.struct(F.col("__slice").alias("s"), F.lit(False).alias("h"))
            after = F.struct((F.col("__slice") + 1).alias("s"), F.lit(True).alias("h"))
            cut = cut.withColumn(
                "__copy", F.explode(F.when(follows, F.array(here, after)).otherwise(F.array(here)))
            )
            cut = cut.withColumn("__slice", F.col("__copy.s")).withColumn("__halo", F.col("__copy.h")).drop("__copy")
        else:
            cut = cut.withColumn("__halo", F.lit(False))
        self.frame = cut.drop("__o", "__at", "__n")

    def _parts(self) -> list[str]:
        return self.keys + (["__slice"] if self.sliced else [])

    def _own(self, value: Column) -> Column:
        return F.when(~F.col("__halo"), value) if self.sliced else value

    # -- building ----------------------------------------------------------

    def window(self, start: int | None = None, end: int | None = None):
        """Ordered window of the key; with ``start``/``end`` a ROWS frame (start >= -halo)."""
        spec = Window.partitionBy(*self._parts()).orderBy(*[F.col(c).asc_nulls_last() for c in self.order])
        return spec if start is None else spec.rowsBetween(start, end)

    def add(self, columns: Mapping[str, Column]) -> "Ordered":
        self.frame = self.frame.withColumns(dict(columns))
        return self

    def _slice_sums(self, sums: Mapping[str, Column]) -> DataFrame:
        rows = self._rows.where(F.col("__hot") & ~F.col("__halo"))
        return rows.groupBy(*self.keys, "__slice").agg(*[F.sum(e).alias(n) for n, e in sums.items()])

    def running(self, sums: Mapping[str, Column]) -> "Ordered":
        """Inclusive running sums of expressions over the input columns, across the whole key."""
        spec = self.window(Window.unboundedPreceding, Window.currentRow)
        if not self.sliced:
            return self.add({n: F.sum(e).over(spec) for n, e in sums.items()})
        self._running += 1
        tag = f"__off{self._running}"
        earlier = Window.partitionBy(*self.keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = self._slice_sums(sums).select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)],
            F.col("__slice").alias("__ks"),
            *[F.sum(n).over(earlier).alias(f"{tag}_{n}") for n in sums],
        )
        match = _and([F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)])
        joined = self.frame.join(F.broadcast(offsets), match & (F.col("__slice") == F.col("__ks")), "left")
        joined = joined.drop("__ks", *[f"__k{i}" for i in range(len(self.keys))])
        self.frame = joined.withColumns(
            {n: F.coalesce(F.col(f"{tag}_{n}"), F.lit(0)) + F.sum(self._own(e)).over(spec) for n, e in sums.items()}
        ).drop(*[f"{tag}_{n}" for n in sums])
        return self

    def position(self, name: str) -> "Ordered":
        """1-based position of the row inside its key."""
        return self.running({name: F.lit(1).cast("long")})

    def totals(self, sums: Mapping[str, Column]) -> "Ordered":
        """Sums of expressions over the input columns for the whole key, on every row."""
        spec = Window.partitionBy(*self._parts())
        if not self.sliced:
            return self.add({n: F.sum(e).over(spec) for n, e in sums.items()})
        self._running += 1
        tag = f"__tot{self._running}"
        hot = self._slice_sums(sums).groupBy(*self.keys).agg(*[F.sum(n).alias(f"{tag}_{n}") for n in sums])
        hot = hot.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], *[f"{tag}_{n}" for n in sums]
        )
        match = _and([F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)])
        joined = self.frame.join(F.broadcast(hot), match, "left").drop(*[f"__k{i}" for i in range(len(self.keys))])
        self.frame = joined.withColumns(
            {n: F.coalesce(F.col(f"{tag}_{n}"), F.sum(self._own(e)).over(spec)) for n, e in sums.items()}
        ).drop(*[f"{tag}_{n}" for n in sums])
        return self

    def done(self) -> DataFrame:
        """The input rows with the added columns."""
        out = self.frame
        if self.sliced:
            out = out.where(~F.col("__halo")).drop("__slice", "__halo", "__hot")
        return out.drop("__one_key") if self._const else out


# -- exact quantiles ---------------------------------------------------------


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    out: str = "q",
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear-interpolated quantiles per key: ``keys``, ``n`` and array ``out``.

    An exact ``percentile`` aggregate would keep every distinct value of a key in
    one task.  So each quantile is bracketed with a mergeable sketch first (rank
    error at most n / accuracy), and only the values between the brackets are
    sorted, about ``8 / accuracy`` of the rows.  The rank inside the bracket is
    counted exactly.  Inputs of every size take this way.
    """
    const = not keys
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    if const:
        rows, keys = rows.withColumn("__all", F.lit(0)), ["__all"]
    keys = list(keys)
    rows = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    margin = 4.0 / accuracy
    marks = [m for p in probs for m in (max(0.0, p - margin), min(1.0, p + margin))]
    brackets = rows.groupBy(*keys).agg(
        F.count("__v").alias("__n"),
        F.percentile_approx("__v", F.array(*[F.lit(float(m)) for m in marks]), accuracy).alias("__b"),
    )
    brackets = cut_lineage(brackets)
    few = F.broadcast if brackets.limit(MAX_LOOKUP_KEYS + 1).count() <= MAX_LOOKUP_KEYS else (lambda side: side)
    renamed = brackets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n", "__b")
    match = _and([F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    joined = rows.join(few(renamed), match).drop(*[f"__k{i}" for i in range(len(keys))])

    whole = F.col("__n") < accuracy
    inside, below = [], []
    for i, p in enumerate(probs):
        low = F.lit(True) if p - margin <= 0 else whole | (F.col("__v") >= F.get("__b", F.lit(2 * i)))
        high = F.lit(True) if p + margin >= 1 else whole | (F.col("__v") <= F.get("__b", F.lit(2 * i + 1)))
        inside.append(F.when(low & high, F.lit(i)))
        below.append(F.when(~low, 1).otherwise(0))
    under = joined.groupBy(*keys).agg(
        F.first("__n").alias("__n"), F.array(*[F.sum(b) for b in below]).alias("__under")
    )
    bands = (
        joined.select(*keys, F.explode(F.array_compact(F.array(*inside))).alias("__i"), "__v")
        .groupBy(*keys, "__i", "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    ranked = Ordered(bands, [*keys, "__i"], ["__v"], aggregated=True).running({"__cum": F.col("__c")}).done()
    under_named = under.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n", "__under")
    ranked = ranked.join(few(under_named), match).drop(*[f"__k{i}" for i in range(len(keys))])
    wanted = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1) * (F.col("__n") - 1)
    ranked = ranked.withColumn("__h", wanted).withColumn("__end", F.col("__cum") + F.get("__under", F.col("__i")))
    has = lambda r: (F.col("__end") - F.col("__c") <= r) & (r < F.col("__end"))
    picked = ranked.groupBy(*keys, "__i", "__n", "__h").agg(
        F.max(F.when(has(F.floor("__h")), F.col("__v"))).alias("__lo"),
        F.max(F.when(has(F.ceil("__h")), F.col("__v"))).alias("__hi"),
    )
    picked = picked.withColumn(
        "__q",
        F.when(
            F.col("__lo").isNull() | F.col("__hi").isNull(),
            F.raise_error(F.lit("quantile rank fell outside its bracket")).cast("double"),
        ).otherwise(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__h") - F.floor("__h"))),
    )
    res = picked.groupBy(*keys).agg(
        F.first("__n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "__q"))), lambda s: s["__q"]).alias(out),
    )
    return res.drop("__all") if const else res


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form (ids, feature, value) of numeric columns in one projection."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    return df.select(*ids, F.explode(pairs).alias("__kv")).select(
        *ids, F.col("__kv.k").alias(name), F.col("__kv.v").alias(value)
    )
