"""Ordered-series operators: rolling frames, differences, recurrences, splits.

Column builders take a ``Frame`` and are used inside ``Line.roll``; functions
that take a ``Line`` return a ``Line``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.ordered import Frame, Line
from weftline.plans.sizing import written

AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}

TINY = 1e-18  # share of a double that no longer changes it
WIDEST = 200  # powers inside a chunk stay within 1e±200
TAIL_PARTS = 64
SPLIT_DIGITS, SPLIT_LEVELS = 3, 5  # hex digits of a level, levels of a hash
COPIES = 1000  # equal rows that one row is unfolded to at a time
DECADES = 150  # decay of a chunk of values with gaps, as a power of ten; a single step has 18 at most


# -- column builders --------------------------------------------------------


def rolling(c: Column, n: int, how: str, f: Frame) -> Column:
    """Aggregate of the last ``n`` rows, null until all ``n`` are known."""
    w = f.rows(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, AGGREGATES[how](c).over(w))


def rolling_centered(c: Column, n: int, how: str, f: Frame) -> Column:
    """Aggregate of the ``n`` rows around the current one, at least one known."""
    left = n // 2
    return AGGREGATES[how](c).over(f.rows(-left, n - 1 - left))


def shift(c: Column, n: int, f: Frame, fill=None) -> Column:
    """Value ``n`` rows earlier (later when negative)."""
    return F.lag(c, n, fill).over(f.spec()) if n >= 0 else F.lead(c, -n, fill).over(f.spec())


def diff(c: Column, f: Frame, n: int = 1) -> Column:
    return c - shift(c, n, f)


def pct_change(c: Column, f: Frame, n: int = 1) -> Column:
    """Relative change; null when the earlier value is zero."""
    return F.try_divide(c, shift(c, n, f)) - 1


def log_return(c: Column, f: Frame) -> Column:
    """ln of the ratio to the row before; null for non-positive prices."""
    before = shift(c, 1, f)
    return F.when((c > 0) & (before > 0), F.ln(c / before))


def reach(decay: float) -> int:
    """Rows after which a term of the recurrence no longer changes a double."""
    return 0 if decay <= 0 else math.ceil(math.log(TINY) / math.log(decay))


CHUNK, STEP = "__chunk", "__j"


def chunked(df: DataFrame, f: Frame, decays: list[float], chunk: int | None = None) -> tuple[DataFrame, Frame]:
    """Number the chunks of rows a recurrence works in, for all ``decays`` at once.

    Chunks are so long that ``d^chunk`` vanishes and so short that ``d^-chunk``
    is still a double.
    """
    if any(not 0 < d < 1 for d in decays):
        raise ValueError("decay must lie strictly between 0 and 1")
    chunk = chunk or min(int(WIDEST / -math.log10(d)) for d in decays)
    if chunk < max(reach(d) for d in decays):
        raise ValueError("decays lie too far apart, or chunk is too short; use separate calls")
    df = df.withColumn("__i", F.row_number().over(f.spec()) - 1)
    df = df.withColumns({CHUNK: F.floor(F.col("__i") / chunk), STEP: (F.col("__i") % chunk).cast("double")})
    return df.drop("__i"), Frame(f.parts, (CHUNK, *f.order), chunk)


def recurrence(df: DataFrame, f: Frame, terms: dict[str, tuple[Column, float]], chunk: int | None = None) -> DataFrame:
    """``y[t] = d * y[t-1] + b[t]`` for every ``out: (b, d)``, null b counting as 0.

    Inside a chunk of rows y is ``d^j`` times a running sum of ``b * d^-j``.
    As ``d^chunk`` vanishes, the only thing a chunk needs from the past is the
    end value of the chunk before it.  All of it is window sums: no Python, and
    no state larger than one row.
    """
    own = f.chunk is None
    if own:
        df, f = chunked(df, f, [d for _, d in terms.values()], chunk)
    b = {o: f"__b_{o}" for o in terms}
    df = df.withColumns({b[o]: F.coalesce(c, F.lit(0.0)) for o, (c, _) in terms.items()})
    within = Window.partitionBy(*f.parts, CHUNK).orderBy(*f.order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    j = F.col(STEP)
    df = df.withColumns(
        {
            o: F.pow(F.lit(d), j) * F.sum(F.col(b[o]) * F.pow(F.lit(d), -j)).over(within)
            for o, (_, d) in terms.items()
        }
    )
    ends = {o: F.last(F.when(j == f.chunk - 1, F.col(o)), True).over(f.past()) for o in terms}
    df = df.withColumns(
        {
            o: F.col(o) + F.pow(F.lit(d), j + 1) * F.coalesce(ends[o], F.lit(0.0))
            for o, (_, d) in terms.items()
        }
    )
    return df.drop(*b.values(), *([CHUNK, STEP] if own else []))


def alpha_of(span: float | None = None, alpha: float | None = None) -> float:
    if (span is None) == (alpha is None):
        raise ValueError("give span or alpha")
    return alpha if alpha is not None else 2.0 / (span + 1.0)


def ewm_recursive(df: DataFrame, f: Frame, terms: dict[str, tuple[Column, float]]) -> DataFrame:
    """Exponential mean ``y[t] = (1-a) y[t-1] + a x[t]`` with ``y = x`` at the first known x.

    ``terms`` is ``out: (x, a)``.  Leading nulls stay null; a null after the
    first known x fails the job (``ewm_gaps`` and the adjusted form take gaps).
    """
    x, k = {o: f"__x_{o}" for o in terms}, {o: f"__k_{o}" for o in terms}
    df = df.withColumns(
        {
            **{x[o]: c for o, (c, _) in terms.items()},
            **{k[o]: F.count(c).over(f.upto()) for o, (c, _) in terms.items()},
        }
    )
    gap = F.raise_error(F.lit("a recursive mean has no value for a gap; use ewm_gaps, the adjusted form, or fill it")).cast("double")
    df = df.withColumns({x[o]: F.when(F.col(x[o]).isNull() & (F.col(k[o]) > 0), gap).otherwise(F.col(x[o])) for o in terms})
    rec = {
        o: (F.when(F.col(k[o]) > 1, F.lit(a) * F.col(x[o])).otherwise(F.col(x[o])), 1.0 - a)
        for o, (_, a) in terms.items()
    }
    df = recurrence(df, f, rec)
    return df.withColumns({o: F.when(F.col(k[o]) > 0, F.col(o)) for o in terms}).drop(*x.values(), *k.values())


def ewm_adjusted(df: DataFrame, f: Frame, terms: dict[str, tuple[Column, float]]) -> DataFrame:
    """Exponential mean as a weighted mean of all values so far, weights ``(1-a)^age``."""
    rec: dict[str, tuple[Column, float]] = {}
    for o, (c, a) in terms.items():
        rec[f"__num_{o}"] = (c, 1.0 - a)
        rec[f"__den_{o}"] = (c.isNotNull().cast("double"), 1.0 - a)
    df = recurrence(df, f, rec)
    return df.withColumns({o: F.try_divide(F.col(f"__num_{o}"), F.col(f"__den_{o}")) for o in terms}).drop(*rec)


def ewm_reach(*alphas: float) -> int:
    return max(reach(1.0 - a) for a in alphas)


def window_list(c: Column, n: int, f: Frame) -> Column:
    """The ``n`` values before the current row as an array; null until there are ``n``."""
    held = F.collect_list(c).over(f.rows(-n, -1))
    return F.when(F.size(held) == n, held)


# -- line operators ---------------------------------------------------------


def cumsum(line: Line, terms: dict[str, Column]) -> Line:
    """Running sum; a null term stays null in its own row."""
    out = line.scan(sums={f"__t_{o}": c for o, c in terms.items()})
    return out.map(
        lambda d: d.withColumns({o: F.when(c.isNotNull(), F.col(f"__t_{o}")) for o, c in terms.items()}).drop(
            *[f"__t_{o}" for o in terms]
        )
    )


def linear_recurrence(line: Line, terms: dict[str, tuple[Column, float]], chunk: int | None = None) -> Line:
    before = max(reach(d) for _, d in terms.values())
    return line.roll(lambda d, f: recurrence(d, f, terms, chunk), before=before)


def ewm_gaps(line: Line, terms: dict[str, tuple[Column, float]]) -> Line:
    """Exponential mean with recursive weights over values with gaps.

    Between known values g rows apart ``y = (w y' + a x) / (w + a)`` with
    ``w = (1-a)^g``; the mean is carried over a gap, and leading nulls stay null.

    Known values are cut into chunks by the decay since the start, so that it
    nearly vanishes over a chunk and is still a double inside it: a chunk needs
    nothing but the end of the chunk before, holds a bounded number of rows, and
    so is worked on alone however long the series is.
    """
    outs = list(terms)
    x, prior, since, rate, chunk, part, local, end = (
        {o: f"__{n}_{o}" for o in outs} for n in ("x", "prior", "since", "rate", "chunk", "part", "local", "end")
    )
    line = line.with_position("__at").map(lambda d: d.withColumns({x[o]: c.cast("double") for o, (c, _) in terms.items()}))
    known = {o: F.col(x[o]).isNotNull() for o in outs}
    line = line.scan(lasts={prior[o]: F.when(known[o], F.col("__at")) for o in outs}, strict=True)

    def rates(d: DataFrame) -> DataFrame:
        made = {}
        for o, (_, a) in terms.items():
            w = F.pow(F.lit(1.0 - a), F.col("__at") - F.col(prior[o]))
            made[rate[o]] = F.when(known[o], F.coalesce(F.greatest(w / (w + a), F.lit(TINY)), F.lit(1.0)))
        return d.withColumns(made)

    line = line.map(rates).scan(sums={since[o]: -F.log10(F.col(rate[o])) for o in outs})
    # rows without a value have chunks of their own, of bounded length
    idle = -1 - F.floor(F.col("__at") / line.block)
    line = line.map(
        lambda d: d.withColumns(
            {chunk[o]: F.when(known[o], F.floor(F.col(since[o]) / DECADES)).otherwise(idle).cast("long") for o in outs}
        )
    )

    def within(d: DataFrame) -> DataFrame:
        for o in outs:
            w = Window.partitionBy(*line.keys, chunk[o]).orderBy("__at")
            upto = w.rowsBetween(Window.unboundedPreceding, 0)
            d = d.withColumn(part[o], F.sum(-F.log10(F.col(rate[o]))).over(upto))
            share = F.when(F.col(prior[o]).isNull(), F.lit(1.0)).otherwise(1.0 - F.col(rate[o]))
            grown = F.sum(share * F.col(x[o]) * F.pow(F.lit(10.0), F.col(part[o]))).over(upto)
            d = d.withColumn(local[o], F.pow(F.lit(10.0), -F.col(part[o])) * grown)
            last = F.lead(F.lit(1)).over(w).isNull()
            d = d.withColumn(end[o], F.when(known[o] & last, F.col(local[o])))
        return d

    line = line.map(within).scan(lasts={f"__before_{o}": F.col(end[o]) for o in outs}, strict=True)
    value = {
        o: F.when(
            known[o],
            F.col(local[o]) + F.pow(F.lit(10.0), -F.col(part[o])) * F.coalesce(F.col(f"__before_{o}"), F.lit(0.0)),
        )
        for o in outs
    }
    line = line.scan(lasts=value)
    made = [n for names in (x, prior, since, rate, chunk, part, local, end) for n in names.values()]
    return line.map(lambda d: d.drop("__at", *made, *[f"__before_{o}" for o in outs]))


def ewm(line: Line, terms: dict[str, tuple[Column, float]], adjust: bool = True) -> Line:
    fn = ewm_adjusted if adjust else ewm_recursive
    return line.roll(lambda d, f: fn(d, f, terms), before=ewm_reach(*[a for _, a in terms.values()]))


def gap_ends(columns: list[str], at: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """The known point (value, position) before and after a gap, as terms of a scan."""
    points = {
        c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.col(at).alias("p")))
        for c in columns
    }
    return {f"__lo_{c}": p for c, p in points.items()}, {f"__hi_{c}": p for c, p in points.items()}


def fill_gaps(df: DataFrame, columns: list[str], at: str, mode: str) -> DataFrame:
    """Straight line between the points that ``gap_ends`` found."""
    made = {}
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        gap = (hi["p"] - lo["p"]).cast("double")
        share = (F.col(at) - lo["p"]).cast("double") / gap
        value = (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(lo.isNull(), F.lit(None))
            .when(hi.isNotNull(), lo["v"] + (hi["v"] - lo["v"]) * share)
        )
        made[c] = value.otherwise(lo["v"]) if mode == "forward" else value
    return df.withColumns(made).drop(*[f"__{side}_{c}" for side in ("lo", "hi") for c in columns])


def interpolate(line: Line, columns: list[str], mode: str = "forward") -> Line:
    """Linear in row position between known values.

    ``forward`` also carries the last value into a trailing gap, ``inside``
    leaves it null.  A leading gap stays null in both.
    """
    if mode not in ("forward", "inside"):
        raise ValueError("mode is 'forward' or 'inside'")
    lasts, nexts = gap_ends(columns, "__at")
    line = line.with_position("__at").scan(lasts=lasts, nexts=nexts)
    return line.map(lambda d: fill_gaps(d, columns, "__at", mode).drop("__at"))


def ffill(line: Line, columns: list[str]) -> Line:
    return line.scan(lasts={f"__f_{c}": F.col(c) for c in columns}).map(lambda d: _take(d, columns))


def bfill(line: Line, columns: list[str]) -> Line:
    return line.scan(nexts={f"__f_{c}": F.col(c) for c in columns}).map(lambda d: _take(d, columns))


def _take(d: DataFrame, columns: list[str]) -> DataFrame:
    return d.withColumns({c: F.col(f"__f_{c}") for c in columns}).drop(*[f"__f_{c}" for c in columns])


def sequence_windows(line: Line, features: list[str], label: str, n: int = 60) -> Line:
    """The ``n`` feature rows before the current row as one array, and the label of the row before."""

    def build(d: DataFrame, f: Frame) -> DataFrame:
        row = F.array(*[F.col(c).cast("double") for c in features])
        d = d.withColumns({"sequence": window_list(row, n, f), "sequence_label": shift(F.col(label), 1, f)})
        return d

    return line.roll(build, before=n).map(lambda d: d.filter(F.col("sequence").isNotNull()))


def split_by_time(line: Line, share: float = 0.8, out: str = "part") -> Line:
    """``train`` for the first ``floor(share * n)`` rows of a key, ``test`` for the rest."""
    line = line.with_position("__at").whole({"__n": F.count(F.lit(1))})
    train = F.col("__at") < F.floor(F.lit(share) * F.col("__n"))
    return line.map(
        lambda d: d.withColumn(out, F.when(train, F.lit("train")).otherwise(F.lit("test"))).drop("__at", "__n")
    )


def split_random(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test tables by a hash of the row's key: a row is in one of them, however often the input is read."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10_000
    test = draw < round(share * 10_000)
    return df.filter(~test), df.filter(test)


def split_exact(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test tables with exactly ``ceil(share * rows)`` test rows, those of the smallest hashes; no sort.

    A row's place is a hash of its key and then of the whole row.  Counts by the first bits of the place (``SPLIT_BINS``
    rows come back) find the bin that the edge falls in, and only that bin is looked into by its next bits, until no bin
    is cut.  Rows equal in all columns share a place; if the edge falls among them, as many copies as are wanted go to each side.
    The split follows the rows, not their order or partitions.
    """
    def words(columns: list[str]) -> Column:
        cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns]
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *cells))

    place = [F.conv(F.substring(words(columns), 1, SPLIT_DIGITS * SPLIT_LEVELS), 16, 10).cast("long") for columns in (keys, df.columns)]
    placed = df.withColumns({"__p0": place[0], "__p1": place[1]})
    bits = 4 * SPLIT_DIGITS
    held, before, edge, wanted = placed.select("__p0", "__p1"), 0, [], None
    for step in range(2 * SPLIT_LEVELS):
        which, level = divmod(step, SPLIT_LEVELS)
        bin_ = F.shiftright(f"__p{which}", bits * (SPLIT_LEVELS - 1 - level)).bitwiseAND((1 << bits) - 1)
        counts = sorted(tuple(r) for r in held.groupBy(bin_.alias("b")).count().collect())
        if wanted is None:
            wanted = math.ceil(share * sum(n for _, n in counts))
        for b, n in counts:
            if before + n >= wanted:
                break
            before += n
        else:  # no row at all
            return df, df.filter(F.lit(False))
        edge.append(b)
        if before + n == wanted or wanted == 0:
            break
        # the bin that is cut: on the first level a share of the table that is one in thousands
        held = held.filter(bin_ == b)
        if step == 0:
            held = written(held, "split-edge")
    upto = F.lit(True)
    ends = []
    for which in (0, 1):
        own = edge[SPLIT_LEVELS * which : SPLIT_LEVELS * (which + 1)]
        shift = bits * (SPLIT_LEVELS - len(own))
        ends.append((F.shiftright(f"__p{which}", shift), sum(b << bits * (len(own) - 1 - i) for i, b in enumerate(own))) if own else None)
    (first, at), second = ends[0], ends[1]
    below, same = first < at, first == at
    if second:
        below, same = below | (same & (second[0] < second[1])), same & (second[0] == second[1])
    drop = ["__p0", "__p1"]
    if wanted == 0:
        return df, df.filter(F.lit(False))
    if before + n == wanted:
        upto = below | same
        return placed.filter(~upto).drop(*drop), placed.filter(upto).drop(*drop)
    # the edge falls among rows that are equal in all columns: copies are counted, not ranked
    take = wanted - before
    alike = placed.filter(same).drop(*drop).groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    running = F.sum("__n").over(Window.orderBy(*[f"`{c}`" for c in df.columns]).rowsBetween(Window.unboundedPreceding, -1))
    alike = alike.withColumn("__t", F.greatest(F.least(take - F.coalesce(running, F.lit(0)), F.col("__n")), F.lit(0)))

    def copies(n: Column) -> DataFrame:
        # ranges of copies, so that no row carries an array as long as their number
        parts = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / COPIES)))
        part = alike.filter(n > 0).withColumn("__c", parts)
        each = F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), n - F.col("__c") * COPIES)))
        return part.withColumn("__e", each).select(*[f"`{c}`" for c in df.columns])

    test = placed.filter(below).drop(*drop).unionByName(copies(F.col("__t")))
    train = placed.filter(~(below | same)).drop(*drop).unionByName(copies(F.col("__n") - F.col("__t")))
    return train, test


def split_by_hash(df: DataFrame, key: Column, buckets: int = 5, out: str = "part") -> DataFrame:
    """Repeatable split: bucket 0 of ``buckets`` is the test part.  No job, no shuffle."""
    return df.withColumn(out, F.when(F.pmod(key, F.lit(buckets)) == 0, F.lit("test")).otherwise(F.lit("train")))


def target_next(line: Line, price: str = "close", k: int = 1, out: str = "target", drop_unlabelled: bool = False) -> Line:
    """1 when the price ``k`` rows ahead is higher, else 0.

    The last ``k`` rows have no answer: they get 0, or null with
    ``drop_unlabelled``.
    """

    def build(d: DataFrame, f: Frame) -> DataFrame:
        up = shift(F.col(price), -k, f) > F.col(price)
        return d.withColumn(out, up.cast("int") if drop_unlabelled else F.coalesce(up, F.lit(False)).cast("int"))

    return line.roll(build, after=k)


def tail_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Last ``n`` rows per key.

    Up to 1000 rows Spark limits each group before the shuffle.  That still
    leaves ``n`` rows of a hot key for each map task, so its rows are limited
    once more in ``TAIL_PARTS`` parts before they meet.  A longer tail goes by
    exact positions, so a hot key is never sorted in one task either.
    """
    if n > 1000:
        line = Line.of(df, keys, order).with_position("__at").whole({"__n": F.count(F.lit(1))})
        return line.result().filter(F.col("__at") >= F.col("__n") - n).drop("__at", "__n")
    latest = [F.desc_nulls_last(c) for c in order]
    df = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(TAIL_PARTS)))
    for parts in ((*keys, "__part"), tuple(keys)):
        back = F.row_number().over(Window.partitionBy(*parts).orderBy(*latest))
        df = df.withColumn("__back", back).filter(F.col("__back") <= n).drop("__back")
    return df.drop("__part")


def warm_tail(df: DataFrame, keys: list[str], order: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """Last ``n`` rows of the keys that have them, and the keys that are too short."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    short = sizes.filter(F.col("rows") < n)
    kept = df.join(short.select(*keys), list(keys), "left_anti")
    return tail_per_key(kept, keys, order, n), short


