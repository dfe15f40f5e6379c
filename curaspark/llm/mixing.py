"""Mixing sources to target weights by entropy balancing (operator 5), in DataFrame functions only.

A document of source s with n words gets the rate r that is closest in relative entropy to taking every document once,

    minimise  sum_i r_i log r_i - r_i + 1   subject to  sum of n_i r_i over source s = T_s  and  0 <= r_i <= limit,

so r_i = min(limit, exp(l_s n_i / scale_s)): an exponential tilt by a document's own words. The convex dual has one multiplier
a source. Its gradient (words taken less words wanted) and Hessian are one distributed aggregate a Newton step; the
constraints of two sources share no document, so the Hessian is diagonal and any number of sources is one table. A step that
leaves the bracket known from the signs of earlier gradients is cut back to its middle, so every source converges.

A rate depends on (source, words) alone, so all sums run over a histogram with one row for each source and length, which is
an exact collapse. Rates turn into whole copies on that histogram: cells of one source go longest first, each takes the
whole number of extra copies nearest to what it and the error carried along want. Which documents of a cell get the extra
copy is told by the order of a hash of id and text, and the cell's threshold is found by counting hash ranges. Texts are
therefore never shuffled nor collected, and rows that repeat are told apart by counting.

Cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in order; a null id is kept;
repeated rows each get their own copies, which may differ by one; sizes of zero throughout give targets and copies of 0; an
empty table gives an empty result; input columns are carried as they are, whatever their names (of types that can be
compared, as repeated rows are grouped).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 64 << 20
KEY = ["key", "size"]


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Targets of sources: (source, size) -> (source, size, target).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes; no target exceeds
    ``limit`` times its source's size, and what is cut off goes to the others by weight until none is above. That fixed
    point is a water level: a source is full when limit * size / weight is below the level, so one ordered pass finds it.
    Input has one row a source, so the ordered passes see no documents.
    """
    cyc = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", cyc)
    ranked = ranked.withColumn("ceiling", F.col("size") * F.lit(float(limit))).withColumn("ratio", F.col("ceiling") / F.col("w"))
    up = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranked.withColumn("all_w", F.sum("w").over(every)).withColumn("budget", F.sum("size").over(every) * F.lit(float(share)))
    level = totals.withColumn("full", F.coalesce(F.sum("ceiling").over(up), F.lit(0.0))).withColumn("gone_w", F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    # the level if this source and all of higher ratio stay open; open sources are those whose own ratio is not below it
    level = level.withColumn("level", (F.col("budget") - F.col("full")) / (F.col("all_w") - F.col("gone_w")))
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(every)
    found = level.withColumn("water", first["level"])
    target = F.least(F.col("ceiling"), F.coalesce(F.col("water"), F.lit(float("inf"))) * F.col("w"))
    return found.select("source", "size", F.when(F.col("size") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def source_key(source: Column) -> Column:
    """A key that is never null: null and the empty string are two sources."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def tilted_rate(lam: Column, x: Column, limit: float) -> Column:
    """min(limit, exp(lam x)); a multiplier of +-infinity stands for all at the limit, or none."""
    at_limit, none = lam == float("inf"), lam == float("-inf")
    return F.when(at_limit, F.lit(float(limit))).when(none, F.lit(0.0)).otherwise(F.exp(F.least(lam * x, F.lit(math.log(limit)))))


def multipliers(cells: DataFrame, plan: DataFrame, limit: float = 2.0, tolerance: float = 1e-9, steps: int = 104, together: int = 8) -> DataFrame:
    """Adds lam and scale, which solve the dual, to plan (key, source_size, n_docs, target); cells are (key, size, n).

    A Newton step is taken on the logarithm of the words taken, the same root with a flatter curve. Sources that want nothing
    or all their limit allows are at the ends of the dual and have multipliers of minus or plus infinity. Every other source
    ends with words taken within ``tolerance`` of its target, in proportion.
    """
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.greatest(F.lit(1), F.col("n_docs")))
    ends = F.when(F.col("target") <= 0, F.lit(float("-inf"))).when(F.col("target") >= F.col("source_size") * F.lit(float(limit)) * (1 - 1e-12), F.lit(float("inf")))
    bounds = F.lit(None).cast("double")
    state = plan.select(*plan.columns, scale.alias("scale"), F.coalesce(ends, F.lit(0.0)).alias("lam"), bounds.alias("lo"), bounds.alias("hi"), ends.isNotNull().alias("done"))
    state = runtime.cut(state)
    positive = cells.where("size > 0").select(*KEY, "n").repartition("key")  # steps of one round then need no further shuffle
    for _ in range(0, steps, together):
        for _ in range(together):
            state = _newton(state, positive, limit, tolerance)
        state = runtime.cut(state)
        if not state.where("not done").limit(1).count():
            return state.drop("lo", "hi", "done")
    raise RuntimeError("entropy balancing: no convergence; raise steps")


def _newton(state: DataFrame, cells: DataFrame, limit: float, tolerance: float) -> DataFrame:
    """One step for every source not done: gradient and Hessian in one aggregate, then arithmetic on one row a source."""
    lam, lo, hi, target = (F.col(c) for c in ("lam", "lo", "hi", "target"))
    x = F.col("size") / F.col("scale")
    words = F.col("n") * F.col("size") * tilted_rate(lam, x, limit)
    slope = F.sum(F.when(lam * x < math.log(limit), words * x).otherwise(0.0))
    sums = state.join(cells, "key", "left").groupBy(*state.columns).agg(F.sum(words).alias("g"), slope.alias("h"))
    g, h = F.col("g"), F.col("h")
    over = g > target
    low, high = F.when(over, lo).otherwise(lam), F.when(over, lam).otherwise(hi)
    newton = lam - F.log(F.try_divide(g, target)) * g / F.when(h > 0, h)
    inside = (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
    bold = F.when(over, F.least(2 * lam, F.lit(-1.0))).otherwise(F.greatest(2 * lam, F.lit(1.0)))
    step = F.when(F.coalesce(inside, F.lit(False)), newton).when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(bold)
    # a bracket of neighbouring numbers is as near as doubles come
    close = (F.abs(g - target) <= tolerance * target) | F.coalesce((high - low) <= 1e-15 * F.abs(low + high), F.lit(False))
    done = F.col("done") | F.coalesce(close, F.lit(False))
    keep = lambda now, then, name: F.when(done, now).otherwise(then).alias(name)
    return sums.select(*[c for c in state.columns if c not in ("lam", "lo", "hi", "done")], keep(lam, step, "lam"), keep(lo, low, "lo"), keep(hi, high, "hi"), done.alias("done"))


def extra_copies(cells: DataFrame, limit: float = 2.0, group: int = 256) -> DataFrame:
    """Adds base and extra to cells (key, size, n, rate): n documents get base copies, extra of them one more.

    Cells go longest first and carry their error. The cells of a source are dealt by length modulo the number of groups, so
    that each group of about ``group`` cells ends with short documents and a small error.
    """
    groups = cells.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / group)).alias("groups"))
    dealt = cells.join(groups, "key").withColumn("g", F.pmod("size", "groups"))
    grouped = dealt.groupBy("key", "g").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "n", "rate"))).alias("items"))
    zero = F.struct(F.lit(0.0).alias("err"), F.array().cast("array<bigint>").alias("extra"))
    base = lambda x: F.when(x["neg"] == 0, F.lit(0.0)).otherwise(F.least(F.floor(x["rate"]), F.lit(float(limit))).cast("double"))

    def carry(acc, x):
        size = (-x["neg"]).cast("double")
        want = (x["rate"] - base(x)) * x["n"] * size + acc["err"]
        room = F.when(base(x) >= limit, F.lit(0)).otherwise(x["n"])
        extra = F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(room, F.floor(want / size + 0.5)))).cast("bigint")
        return F.struct((want - extra * size).alias("err"), F.concat(acc["extra"], F.array(extra)).alias("extra"))

    found = grouped.withColumn("extra", F.aggregate("items", zero, carry, lambda a: a["extra"]))
    out = found.select("key", F.explode(F.arrays_zip("items", "extra")).alias("x"))
    item = F.col("x.items")
    return out.select("key", (-item["neg"]).alias("size"), item["n"].alias("n"), item["rate"].alias("rate"), base(item).cast("int").alias("base"), F.col("x.extra").alias("extra"))


def thresholds(rows: DataFrame, cells: DataFrame, hint=lambda df: df) -> DataFrame:
    """(key, size, edge, q, m) of cells (key, size, n, extra) with 0 < extra < n, over rows (key, size, h).

    The ``extra`` rows of least h are those below ``edge`` and q of the m rows at it. The hashes of a cell of n rows are
    counted in about sqrt(n) ranges; only the range that holds the edge is looked into, so no task sees a whole hot cell.
    ``hint`` marks tables of at most one row a cell.
    """
    split = cells.where("extra > 0 and extra < n").select(*KEY, "extra", F.ceil(F.sqrt("n")).alias("ranges"))
    part = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("ranges")), F.col("ranges") - 1).alias("part")
    ranged = rows.join(hint(split), KEY).select(*KEY, "h", "extra", part)
    counts = ranged.groupBy(*KEY, "part", "extra").agg(F.count(F.lit(1)).alias("m"))
    up = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("run", F.sum("m").over(up)).withColumn("left", F.col("extra") - F.col("run") + F.col("m"))
    held = runtime.staged(run.where("left > 0 and run >= extra").select(*KEY, "part", "left"), "mix-ranges")
    inner = ranged.join(hint(held), [*KEY, "part"]).groupBy(*KEY, "h", "left").agg(F.count(F.lit(1)).alias("m"))
    up = Window.partitionBy(*KEY).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    run = inner.withColumn("run", F.sum("m").over(up)).withColumn("q", F.col("left") - F.col("run") + F.col("m"))
    return run.where("q > 0 and run >= left").select(*KEY, F.col("h").alias("edge"), "q", "m")


def mixed(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] | None = None, limit: int = 2, **targets) -> DataFrame:
    """One row for each document: struct ``doc`` of the columns ``keep`` (all by default), size, source_size, target, rate, copies.

    Texts are read once where they aren't kept: the narrow rows are staged. Where they are kept, they are read a second time to
    meet the decisions of their cells, a table that is broadcast, instead of being shuffled.
    """
    keep = list(docs.columns if keep is None else keep)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    doc = F.struct(*[F.col(f"`{c}`") for c in keep])
    all_rows = docs.select(doc.alias("doc"), source.alias("source"), source_key(source).alias("key"), size.alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    if text_col in keep:
        narrow = runtime.staged(all_rows.select("source", *KEY, "h"), "mix-rows")
    else:
        narrow = all_rows = runtime.staged(all_rows, "mix-rows")

    cells = runtime.staged(narrow.groupBy("source", *KEY).agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sums = cells.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs"))
    aims = source_targets(sums.select("source", "size"), limit=limit, **targets).select(source_key(F.col("source")).alias("key"), F.col("size").alias("source_size"), "target")
    plan = multipliers(cells, aims.join(sums.select("key", "n_docs"), "key"), limit)
    rates = cells.select(*KEY, "n").join(plan, "key").select(*KEY, "n", tilted_rate(F.col("lam"), F.col("size") / F.col("scale"), limit).alias("rate"))
    decided = runtime.staged(extra_copies(rates, limit), "mix-copies")
    # tables of one row a cell are broadcast where their counted bytes allow; past that Spark joins them as it sees fit
    held = cells.agg(F.sum(F.octet_length("key") + F.lit(128))).first()[0] or 0
    hint = F.broadcast if held <= BROADCAST_BYTES else lambda df: df
    edges = thresholds(narrow, decided, hint)
    decided = decided.join(edges, KEY, "left").join(plan.select("key", "source_size", "target"), "key")
    decided = runtime.staged(decided, "mix-decided")

    met = all_rows.join(hint(decided), KEY)
    tied = (F.col("h") == F.col("edge")) & (F.col("q") < F.col("m"))
    more = F.coalesce(F.col("h") <= F.col("edge"), F.col("extra") >= F.col("n")) & (F.col("extra") > 0)
    shape = ["doc", "size", "source_size", "target", "rate"]
    plain = met.where(~F.coalesce(tied, F.lit(False))).select(*shape, (F.col("base") + more.cast("int")).alias("copies"))
    if not decided.where("q < m").limit(1).count():
        return plain
    return plain.unionByName(_repeats(met.where(tied), shape))


def _repeats(rows: DataFrame, shape: list[str], chunk: int = 4096) -> DataFrame:
    """Rows that all lie at their cell's edge, where q of m get one copy more: counted and written out again in chunks."""
    same = rows.groupBy("key", "h", "q", "base", *shape).agg(F.count(F.lit(1)).alias("mm"))
    up = Window.partitionBy("key", "size", "h").orderBy("doc").rowsBetween(Window.unboundedPreceding, 0)
    same = same.withColumn("mine", F.greatest(F.lit(0), F.least("mm", F.col("q") - F.sum("mm").over(up) + F.col("mm"))))
    parts = same.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mm") - 1, F.lit(chunk).cast("long"))))
    parts = parts.repartition("key", "h", "first")
    rank = F.explode(F.sequence(F.col("first"), F.least(F.col("first") + chunk, F.col("mm")) - 1))
    return parts.withColumn("rank", rank).select(*shape, (F.col("base") + (F.col("rank") < F.col("mine")).cast("int")).alias("copies"))


def expanded(mix: DataFrame) -> DataFrame:
    """The mix itself: documents repeated as often as they are taken."""
    return mix.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
