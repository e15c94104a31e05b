"""Mixing sources to target weights by entropy balancing.

Each source has a target in words. Document rates r (expected copies, 0 to 2) stay as close as they can, in
entropy, to one copy each, under the constraint that a source's words times rates are its target. The dual is
convex with one multiplier for each source; its solution tilts the odds of a copy exponentially with the
document's size: r = 2 e**(t x) / (1 + e**(t x)), x the size over the source's mean. The multipliers come from
distributed Newton steps: the gradient and curvature of all sources are one aggregate over the counts of
documents by source and size, which give the same sums as the documents and are far fewer. Steps that leave the
bracket of a multiplier are replaced by its middle. State goes to shared storage after each step; nothing goes to
the driver but the largest error. Sums are of decimals: the order in which rows arrive changes nothing, so reruns agree.

Rates become copies by systematic rounding: along a source's sizes the running sum of rates is rounded, so that
the words taken are off by less than one document; a few single documents then close most of that gap. The copies
of documents of one source and size are dealt by hash of doc_id, in parts of about `part` documents.

Cases: null texts and texts without words have size 0 and keep one copy; null sources are one source, the last;
a source whose target is twice its size has all rates 2; repeated rows are rows of their own; an empty table
gives no rows. Added columns replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

ADDED = ("size", "source_size", "target", "copies", "taken")


def sized(documents: DataFrame) -> DataFrame:
    """documents with `size`, its number of words."""
    return documents.drop(*ADDED).withColumn("size", F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(C.WORD)).cast("long"))


def _places(sources: DataFrame) -> DataFrame:
    """sources with `place`, from 0 by code point, null last: numbers within ranges, and the rows of the ranges before."""
    key = [F.col("source").isNull(), F.col("source")]
    d = sources.repartitionByRange(*key).withColumn("range", F.spark_partition_id())
    d = C.written(d, "mixing-sources")
    sizes = d.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))  # a row for each partition
    before = sizes.select("range", F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*key)) - 1
    return d.join(F.broadcast(before), "range").withColumn("place", place).drop("range", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n, target: `share` of all words, divided by the weights repeated along the sources' order, up to `most` times a source's words.

    The level L at which targets are min(most * size, weight * L) and sum up rises round by round: sources that stop
    below it give what is over to the others, until no more stop. A round is an aggregate over one row for each source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    s = C.written(_places(sources).withColumn("weight", weight).drop("place"), "mixing-weights")
    cap = F.lit(most) * F.col("source_size")
    exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    total, stopped, level = s.agg(F.sum("source_size")).first()[0] or 0, -1, 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        r = s.agg(F.count_if(full).alias("n"), exact(F.when(full, cap).otherwise(0.0)).alias("full"), exact(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if r.n == stopped or not r.open:
            break
        stopped, level = r.n, (share * total - r.full) / r.open
    target = F.least(cap, F.col("weight") * F.lit(level)) if r.open else cap
    return s.select("source", "source_size", "n", target.alias("target"))


def _rate():
    return F.when(F.col("whole"), F.lit(2.0)).otherwise(F.lit(2.0) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * F.col("x"))))))


def solve(counts: DataFrame, goal: DataFrame, steps: int = 60, near: float = 1e-7) -> DataFrame:
    """counts: source, size, m. goal: source, source_size, n, target. Result: source, tilt, whole, mean."""
    state = goal.select("source", "target", (F.col("source_size") / F.col("n")).alias("mean"), (F.col("target") >= F.col("source_size") * 2 * (1 - 1e-12)).alias("whole"),
                        F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(1.0).alias("error"))
    state = C.written(state.where("target is not null and source_size > 0"), "mixing-state")
    for _ in range(steps):
        old = state
        rows = counts.join(state, counts.source.eqNullSafe(state.source)).drop(counts.source).withColumn("x", F.col("size") / F.col("mean")).withColumn("p", _rate() / 2)
        words = F.col("m") * F.col("size")
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        sums = rows.groupBy("source").agg(exact(words * 2 * F.col("p")).alias("got"), exact(words * 2 * F.col("x") * F.col("p") * (1 - F.col("p"))).alias("slope"))
        s = old.join(sums.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("off", F.col("got") - F.col("target"))
        s = s.withColumn("low", F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("high")))
        step = F.col("tilt") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce(F.try_divide(F.col("off"), F.col("slope")), F.signum("off") * 4)))
        tilt = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
        error = F.when(F.col("whole"), 0.0).otherwise(F.abs("off") / F.greatest(F.col("target"), F.lit(1.0)))
        state = C.written(s.select("source", "target", "mean", "whole", F.when(error <= near, F.col("tilt")).otherwise(tilt).alias("tilt"), "low", "high", error.alias("error")), "mixing-state")
        C.discard(old)
        if (state.agg(F.max("error")).first()[0] or 0) <= near:
            break
    return state.select("source", "tilt", "whole", "mean")


def allot(narrow: DataFrame, part: int = 512, gaps: int = 4, **weighing) -> DataFrame:
    """narrow: doc_id, source, size of all rows. Result by source, size, part: parts, copies of each row (base) and how many rows get one more (extra); source_size and target."""
    goal = C.written(targets(narrow, **weighing), "mixing-goal")
    counts = C.written(narrow.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("m")), "mixing-counts")
    tilts = solve(counts, goal)
    g = goal.withColumnRenamed("source", "of")
    t = tilts.withColumnRenamed("source", "from")
    c = counts.join(g, F.col("source").eqNullSafe(F.col("of"))).drop("of", "n").join(t, F.col("source").eqNullSafe(F.col("from"))).drop("from")
    c = c.withColumn("x", F.col("size") / F.col("mean")).withColumn("rate", _rate())
    along = Window.partitionBy("source").orderBy("size")
    whole = Window.partitionBy("source")
    start = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)
    c = c.withColumn("end", F.floor(F.sum((F.col("m") * F.col("rate")).cast("decimal(38,9)")).over(along).cast("double") + start + 1e-9)).withColumn("k", F.col("end") - F.coalesce(F.lag("end").over(along), F.floor(start + 1e-9)))
    c = c.withColumn("k", F.least(F.greatest(F.col("k"), F.lit(0)), 2 * F.col("m")))
    for _ in range(gaps):  # one document more, or less, of the largest size within the gap
        c = c.withColumn("gap", F.round(F.col("target") - F.sum(F.col("k") * F.col("size")).over(whole)))
        can = (F.col("size") <= F.abs("gap")) & F.when(F.col("gap") > 0, F.col("k") < 2 * F.col("m")).otherwise(F.col("k") > 0)
        c = c.withColumn("pick", F.max(F.when(can, F.col("size"))).over(whole)).withColumn("k", F.when(F.col("size") == F.col("pick"), F.col("k") + F.signum("gap").cast("long")).otherwise(F.col("k")))
    c = C.written(c.select("source", "size", "m", "source_size", "target", F.col("k").cast("long").alias("k"), F.ceil(F.col("m") / part).cast("long").alias("parts")), "mixing-copies")
    # parts of a class: how many rows each has, and its share of the extra copies
    big = c.where("parts > 1").select(F.col("source").alias("of"), F.col("size").alias("as"), "parts")
    rows = narrow.where("size > 0").join(big, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("as")))
    sizes = rows.groupBy("source", "size", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    ps = sizes.withColumnRenamed("source", "of").withColumnRenamed("size", "as")
    c = c.join(ps, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("as")), "left").drop("of", "as").withColumn("part", F.coalesce("part", F.lit(0).cast("long"))).withColumn("rows", F.coalesce("rows", F.col("m")))
    base = F.floor(F.col("k") / F.col("m"))
    c = c.withColumn("base", base.cast("long")).withColumn("rest", F.col("k") - base * F.col("m"))
    upto = Window.partitionBy("source", "size").orderBy("part")
    cut = lambda n: F.floor(n * F.col("rest") / F.col("m"))
    c = c.withColumn("sum", F.sum("rows").over(upto)).withColumn("extra", (cut(F.col("sum")) - cut(F.col("sum") - F.col("rows"))).cast("long"))
    c = c.select("source", "size", "source_size", "target", "parts", "part", "base", "extra")
    # rows of no size: one copy
    none = goal.select("source", F.lit(0).cast("long").alias("size"), "source_size", "target", F.lit(1).cast("long").alias("parts"), F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("base"), F.lit(0).cast("long").alias("extra"))
    return C.written(c.unionByName(none), "mixing-plan")


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with source, size, doc_id and any others): each with source_size, target, copies and taken. plan: of `allot`."""
    p = C.free_prefix(rows)
    clash = [c for c in ("source_size", "target", "copies", "taken") if c in rows.columns]
    r = rows.drop(*clash)
    classes = plan.groupBy(F.col("source").alias(f"{p}of"), F.col("size").alias(f"{p}as")).agg(F.max("parts").alias(f"{p}parts"))
    same = F.col("source").eqNullSafe(F.col(f"{p}of")) & (F.col("size") == F.col(f"{p}as"))
    r = r.join(classes, same).drop(f"{p}of", f"{p}as")
    r = r.withColumn(f"{p}hash", F.xxhash64("doc_id")).withColumn(f"{p}part", F.pmod(f"{p}hash", f"{p}parts"))
    q = plan.select(F.col("source").alias(f"{p}of"), F.col("size").alias(f"{p}as"), F.col("part").alias(f"{p}in"), "source_size", "target", F.col("base").alias(f"{p}base"), F.col("extra").alias(f"{p}extra"))
    r = r.join(q, same & (F.col(f"{p}part") == F.col(f"{p}in")))
    turn = F.row_number().over(Window.partitionBy("source", "size", f"{p}part").orderBy(f"{p}hash", "doc_id"))
    r = r.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col(f"{p}base") + F.when(turn <= F.col(f"{p}extra"), 1).otherwise(0)).cast("int"))
    return r.withColumn("taken", F.col("copies") * F.col("size")).drop(*[f"{p}{x}" for x in ("of", "as", "in", "base", "extra", "hash", "part", "parts")])


def mix(documents: DataFrame, **how) -> DataFrame:
    """documents, each row as often as the mix takes it."""
    name, copies = C.free_name(documents, "rid"), C.free_name(documents, "copies")
    rows = C.numbered(documents, name)
    narrow = C.written(sized(rows.select(F.col(name).alias("rid"), F.col("doc_id"), "source", "text")).drop("text"), "mixing-sizes")
    taken = mixed(narrow, allot(narrow.drop("rid"), **how)).where("copies > 0").select(F.col("rid").alias(name), F.col("copies").alias(copies))
    again = C.free_name(documents, "again")
    # the copies are the hashed side: whole texts pass by, and none is sorted or held
    return rows.join(taken.hint("shuffle_hash"), name).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*documents.columns)
