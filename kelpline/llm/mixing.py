"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix in proportion to its weight; a source whose share passes its maximum of epochs is clamped
there, and the excess is dealt again to the rest by weight until no source is above its cap. A source's share is then taken as
whole repetitions of all its documents plus one more of a seeded choice of them.

Defined cases: null and empty texts have size 0 and take 0; a null source is a source of its own, the last; sources of size 0
get target 0; repeated ids are separate rows with equal draws; rows without an id draw by their text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix as a part of all words, and the most epochs of a source.
TOTAL, MAX_EPOCHS = 1.5, 2.0
#: Draws per source are cut into so many cells; only the cell that the share ends in is ordered row by row.
CELLS = 4096
#: Cells that are broadcast to the texts; more are joined by a shuffle.
MAX_BROADCAST = 200_000
SEED = "mix-1"


def water_fill(sizes: list[int], weights: list[float], total: float, max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Targets of the sources, one number each: clamp at the caps and deal the rest again by weight until none is above."""
    caps = [max_epochs * s for s in sizes]
    target, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > caps[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = caps[i]
        left -= sum(caps[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(docs: DataFrame) -> DataFrame:
    """The rows with a seeded draw that depends on the id alone, or on the text where there is no id, and its cell."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), who)), 1, 15), 16, 10).cast("long")
    return docs.withColumn("draw", draw).withColumn("cell", F.pmod(F.col("draw"), F.lit(CELLS)).cast("int"))


def sized(docs: DataFrame) -> DataFrame:
    """The rows without their texts: words, draw and cell."""
    return drawn(docs.select("doc_id", "source", "text")).select("doc_id", "source", words("text").alias("size"), "draw", "cell")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, repeats for every row."""
    rows = checkpointed(sized(docs))
    return _repeats(rows, _ends(docs, rows, weights, total, max_epochs)).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs``, each as many times as it is taken. Texts go along, so no id is needed to find them again."""
    ends = _ends(docs, checkpointed(sized(docs)), weights, total, max_epochs)
    taken = _repeats(drawn(docs), ends).filter("repeats > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("_copy")
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], copies).drop("_copy")


def targets(sources: DataFrame, weights: tuple[float, ...], total: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target): the water-filling of ``water_fill`` over a table of (source, source_size), a row for each source.

    Sources are clamped in the order in which a rising level reaches their caps, so the level is found by running sums over them.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1  # by code point, null last
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    rows = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    all_rows = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.lit(float(total)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    ranked = rows.filter("source_size > 0").select("*", rest.alias("rest"), free.alias("free"), F.row_number().over(by_cap).alias("k"))
    # The first source that the level doesn't lift to its cap, and with it all later ones.
    stops = F.when(F.col("rest") / F.col("free") <= F.col("cap") / F.col("weight"), F.struct("k", "rest", "free"))
    levels = ranked.withColumn("at", F.min(stops).over(all_rows))
    target = F.when(F.col("at").isNull() | (F.col("k") < F.col("at.k")), F.col("cap")).otherwise(F.col("at.rest") * F.col("weight") / F.col("at.free"))
    return levels.select("source", "source_size", target.alias("target")).unionByName(rows.filter("source_size = 0").select("source", "source_size", F.lit(0.0).alias("target")))


def _ends(docs: DataFrame, rows: DataFrame, weights: tuple[float, ...], total: float, max_epochs: float) -> DataFrame:
    """What is taken of each (source, cell of the draw): source_size, target, whole and part of its source, cell_size, and the words below it.

    Sizes are summed per cell before they are shuffled; sources are never gathered. A source's fractional repetition goes to the cells below
    the one where the share ends, and there to the rows below the share, in the order of their draws.
    """
    cells = checkpointed(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    plan = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("part", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    running = cells.withColumn("below", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    ends = running.alias("c").join(plan.alias("p"), F.expr("c.source <=> p.source")).select("c.*", "p.source_size", "p.target", "p.whole", "p.part")
    return F.broadcast(ends) if cells.count() <= MAX_BROADCAST else ends


def _repeats(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with how often each is taken. Words of rows that come with their texts are only counted where the share ends."""
    joined = rows.alias("r").join(ends.alias("e"), F.expr("r.cell = e.cell and r.source <=> e.source")).select("r.*", "e.cell_size", "e.below", "e.source_size", "e.target", "e.whole", "e.part")
    inside = (F.col("below") < F.col("part")) & (F.col("below") + F.col("cell_size") > F.col("part"))
    # The cell that a share ends in: about one row in CELLS, ordered by draw; the row nearest the share is where it stops.
    in_cell = Window.partitionBy("source", "cell").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("size") if "size" in rows.columns else words("text")
    split = joined.filter(inside).withColumn("_size", size).withColumn("_upto", F.col("below") + F.sum("_size").over(in_cell))
    split = split.withColumn("more", (F.col("_upto") - F.col("_size") / 2 <= F.col("part")).cast("long")).drop("_size", "_upto")
    even = joined.filter(~inside).withColumn("more", (F.col("below") + F.col("cell_size") <= F.col("part")).cast("long"))
    return even.unionByName(split).withColumn("repeats", F.col("whole") + F.col("more"))
