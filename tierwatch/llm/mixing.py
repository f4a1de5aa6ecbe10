"""Mixing sources to target weights by entropy balancing.

    sizes     words of every document; sizes are counted by source, so what
              follows reads a table of distinct sizes, not documents
    targets   sources in code-point order weigh 3, 1, 2, 3, 1, 2, ...; a water
              level shares BUDGET times all words by weight, no source above
              MOST times its own words
    dual      document rates nearest to one copy each in entropy, between 0 and
              MOST, whose words meet the source's target, are exp(tilt * size)
              cut at MOST.  The tilt solves the convex dual: Newton steps for all
              sources at once, from a distributed sum of gradient and curvature,
              kept inside a bracket that every step narrows
    copies    a document's number of copies is floor(rate + u + shift), u from
              the hash of its id and text; each source's one shift is the
              quantile at which the copies' words reach the target, found by
              histograms that refine the bin it lies in
    repair    what is then still missing or too much is met by one copy more or
              less of the document whose size comes nearest to it, a few times

All sums are partial before the shuffle: a source with a third of all rows is
one row a task and size.  The driver sees sums over all sources only.

Defined results: null text has size 0 and is never taken; sources without words
have target 0; a null source is a source, the last one; rows without doc_id take
part; rows of equal id and text share their fate up to the repair; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierwatch.operators.ranking import global_rank

from .common import cut

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2.0
STEPS = 60              # at most; the bracket alone is narrowed to nothing by then
CLOSE = 1e-9            # of the target
BINS, ROUNDS = 4096, 2
REPAIRS = 4


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u, row): u in [0, 1) from the id and the text."""
    text = F.coalesce("text", F.lit(""))
    u = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 40)) / float(1 << 40)
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
                       u.alias("u"), F.monotonically_increasing_id().alias("row"))


def weighted_sources(profile: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, size, weight) of every source, weights in turn by code point."""
    sums = profile.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = global_rank(sums, [], [F.col("source").asc_nulls_last()], "rank", 1)      # one row a source
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    return ranked.select("source", "source_size", turn.alias("weight"))


def targets(sources: DataFrame, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target): the level rises until the shares,
    none above ``most`` times its source, add up to the budget."""
    room = most * F.col("source_size")
    level = 0.0
    while True:
        full = (F.col("weight") * level >= room) & F.lit(level > 0) | (F.col("source_size") == 0)
        total, used, weight = sources.agg(F.sum("source_size"), F.sum(F.when(full, room)),
                                          F.sum(F.when(~full, F.col("weight")))).first()      # three sums
        above = (budget * (total or 0) - (used or 0.0)) / weight if weight else level
        if above <= level:
            break
        level = above
    return sources.withColumn("target", F.least(room, F.col("weight") * level))


def _rate(tilt: Column, size: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(tilt * size))


def tilts(profile: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """(source, tilt): the solution of the dual for every source.  A target of
    ``most`` times the words has none that is finite: rates are at the bound."""
    unit = F.col("size") / F.col("scale")
    scaled = profile.where("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("scale"))
    state = wanted.join(scaled, wanted.source.eqNullSafe(scaled.source)).select(
        wanted.source, "scale", "target", (F.col("target") >= most * F.col("source_size") * (1 - CLOSE)).alias("full"),
        F.log(F.col("target") / F.col("source_size")).alias("tilt"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"), F.lit(False).alias("met"))
    state = cut(state.withColumn("met", F.col("full")), "tilts")
    rows = profile.where("size > 0").withColumnRenamed("source", "of")
    for _ in range(STEPS):
        if state.where("not met").isEmpty():
            break
        rate = F.exp(F.col("tilt") * unit)
        sums = (rows.join(state.where("not met"), F.col("of").eqNullSafe(F.col("source"))).groupBy("of").agg(
            F.sum(F.least(F.lit(most), rate) * F.col("size") * F.col("n")).alias("words"),
            F.sum(F.when(rate < most, rate * F.col("size") * unit * F.col("n")).otherwise(0.0)).alias("slope")))
        over = F.col("words") - F.col("target")
        low = F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        step = state.join(sums, F.col("of").eqNullSafe(F.col("source")), "left").select(
            "source", "scale", "target", "full", "tilt", low.alias("low"), high.alias("high"),
            (F.col("met") | (F.abs(over) <= CLOSE * F.col("target"))).alias("met"), over.alias("over"), "slope")
        newton = F.col("tilt") - F.try_divide("over", "slope")
        inside = ((F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
                  & (F.abs(newton - F.col("tilt")) <= F.abs(F.col("tilt")) + 4.0))
        wider = F.when(F.col("over") < 0, F.col("tilt") + F.abs(F.col("tilt")) + 1.0).otherwise(F.col("tilt") - F.abs(F.col("tilt")) - 1.0)
        nxt = F.when(F.col("met"), F.col("tilt")).when(inside, newton).otherwise(
            F.coalesce((F.col("low") + F.col("high")) / 2, wider))
        state = cut(step.select("source", "scale", "target", "full", nxt.alias("tilt"), "low", "high", "met"), "tilts")
    return state.select("source", F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.col("tilt") / F.col("scale")).alias("tilt"))


def _copies(shift: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(int(MOST)), F.floor(F.col("rate") + F.col("u") + shift))).cast("bigint")


def shifts(rated: DataFrame, wanted: DataFrame) -> DataFrame:
    """(of, shift): per source, the largest shift found whose copies have no
    more words than the target.  A document's k-th copy is taken from the shift
    k - rate - u on; these places are counted in BINS bins, then those of the
    bin that the target lies in, and so on."""
    k = F.explode(F.array(*[F.lit(float(i)) for i in range(1, int(MOST) + 1)]))
    events = rated.where("size > 0").select("of", "size", (F.col("rate") + F.col("u")).alias("v"), k.alias("k")).select(
        "of", "size", (F.col("k") - F.col("v")).alias("place"))
    state = wanted.select(F.col("source").alias("of_s"), F.lit(-MOST - 1).alias("low"), "target", F.lit(0.0).alias("below"))
    width = 2 * MOST + 2
    for _ in range(ROUNDS):
        bins = F.floor((F.col("place") - F.col("low")) / (width / BINS))
        counted = (events.join(state, F.col("of").eqNullSafe(F.col("of_s"))).where((bins >= 0) & (bins < BINS))
                   .groupBy("of", bins.alias("bin")).agg(F.sum("size").alias("words")))
        upto = Window.partitionBy("of").orderBy("bin")                  # at most BINS rows a source
        run = counted.select("of", "bin", F.sum("words").over(upto).alias("upto"))
        fits = run.join(state, F.col("of").eqNullSafe(F.col("of_s"))).where(F.col("below") + F.col("upto") <= F.col("target")).groupBy("of").agg(
            F.max("bin").alias("bin"), F.max("upto").alias("upto"))
        # the next bin with words is the one that holds the target
        after = run.withColumn("next", F.lead("bin").over(upto))
        first = run.groupBy("of").agg(F.min("bin").alias("first"))
        nxt = (first.join(fits.withColumnRenamed("of", "f"), F.col("of").eqNullSafe(F.col("f")), "left")
               .join(after.select(F.col("of").alias("a"), F.col("bin").alias("at"), "next"),
                     F.col("of").eqNullSafe(F.col("a")) & (F.col("bin") == F.col("at")), "left")
               .select("of", F.when(F.col("bin").isNull(), F.col("first")).otherwise(F.coalesce("next", F.col("bin") + 1)).alias("bin"),
                       F.coalesce("upto", F.lit(0)).alias("upto")))
        state = cut(state.join(nxt, F.col("of").eqNullSafe(F.col("of_s")), "left").select(
            "of_s", (F.col("low") + F.coalesce("bin", F.lit(0)) * (width / BINS)).alias("low"), "target",
            (F.col("below") + F.coalesce("upto", F.lit(0))).alias("below")), "shifts")
        width = width / BINS
    return state.select("of_s", F.col("low").alias("shift"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, rate, copies)."""
    sized = cut(word_sizes(docs), "sizes")
    profile = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "profile")
    wanted = cut(targets(weighted_sources(profile, weights), budget), "targets")
    tilt = tilts(profile, wanted).withColumnRenamed("source", "s")
    rated = sized.withColumnRenamed("source", "of").join(tilt, F.col("of").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "of", "size", "u", "row", F.when(F.col("size") > 0, _rate(F.col("tilt"), F.col("size"), MOST)).otherwise(0.0).alias("rate"))
    rated = cut(rated, "rates")
    shift = shifts(rated, wanted)
    chosen = cut(rated.join(shift, F.col("of").eqNullSafe(F.col("of_s")), "left").select(
        "doc_id", "of", "size", "u", "row", "rate", F.when(F.col("size") > 0, _copies(F.col("shift"))).otherwise(
            F.lit(0).cast("bigint")).alias("copies")), "copies")
    for _ in range(REPAIRS):
        sums = chosen.groupBy("of").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        left = sums.join(wanted, F.col("of").eqNullSafe(F.col("source"))).select(
            F.col("of").alias("l"), (F.col("target") - F.col("words")).alias("left")).where("abs(left) >= 1")
        gap = F.abs(F.abs("left") - F.col("size"))
        free = ((F.col("left") > 0) & (F.col("copies") < MOST)) | ((F.col("left") < 0) & (F.col("copies") > 0))
        one = (chosen.where("size > 0").join(left, F.col("of").eqNullSafe(F.col("l"))).where(free & (gap < F.abs("left")))
               .groupBy("of").agg(F.min(F.struct(gap.alias("gap"), F.col("u"), F.col("doc_id"), F.col("row"),
                                                 F.signum("left").cast("bigint").alias("by"))).alias("m"))
               .select(F.col("m.row").alias("at"), "m.by"))
        chosen = cut(chosen.join(one, F.col("row") == F.col("at"), "left").withColumn(
            "copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("at", "by"), "copies")
    return chosen.join(wanted, F.col("of").eqNullSafe(F.col("source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")
