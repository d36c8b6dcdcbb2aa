"""Operator 13: mixing of sources to target weights by repeating and thinning documents.

The words of each source are added up; targets follow from weights and from the
most that a source may be repeated. A document is emitted as often as the whole
part of its source's rate says, and once more by a draw from its hash whose
probability is the fraction.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from layerkit.llm.common import prepare
from layerkit.operators.ordered import add_index
from layerkit.session import stage

# Weights of the sources in order, repeating; share of all words to take; most repetitions of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
# Draws per document, of which each source takes the one that comes nearest to its target.
DRAWS = 64
# A prime, and the step between the multipliers of the draws: their products fit 64 bits.
_MODULUS, _STRIDE = (1 << 31) - 1, 15485863
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of every source of ``sizes`` (``source``, ``size``).

    Sources take the weights in turn, by code point with null last. All targets
    together are ``share`` of all words. One above ``most`` times its source
    stops there, and what it leaves over is dealt to the others by weight, until
    none is above. Each round is one aggregate over the sources and two numbers
    to the driver; the sources themselves are ordered and kept as a table. Where
    ``share`` asks for more than ``most`` of everything, all stop at ``most``.
    """
    totals = stage(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "source-sizes")
    # Nulls sort first; a column that says whether the name is null puts them last.
    placed = add_index(totals.withColumn("unnamed", F.col("source").isNull()), "place", ["unnamed", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = stage(placed.select("source", "source_size", weight.cast("long").alias("weight")), "source-weights")
    whole = int(placed.agg(F.coalesce(F.sum(F.col("source_size").cast("decimal(38,0)")), F.lit(0))).first()[0])
    # A free source gets weight * (share * whole - most * stopped) / free weights: numerator and denominator are whole numbers.
    over, under = share.numerator * whole, share.denominator
    stopped_words, free_weight, before = 0, None, None
    while True:
        free = _free(over - under * most * stopped_words, under, free_weight, most) if free_weight else F.lit(True)
        now = placed.agg(
            F.coalesce(F.sum(F.when(~free, F.col("source_size").cast("decimal(38,0)"))), F.lit(0)).alias("stopped"),
            F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        stopped_words, free_weight = int(now.stopped), int(now.free)
        if not free_weight or before == (stopped_words, free_weight):
            break
        before = stopped_words, free_weight
    top = (F.col("source_size") * most).cast("double")
    if not free_weight:
        return placed.select("source", "source_size", top.alias("target"))
    num, den = over - under * most * stopped_words, under * free_weight
    free = _free(num, under, free_weight, most)
    dealt = F.col("weight") * F.lit(float(num)) / F.lit(float(den))
    return placed.select("source", "source_size", F.when(free, dealt).otherwise(top).alias("target"))


def _free(num: int, under: int, free_weight: int, most: int) -> Column:
    """Whether a source stays below ``most`` times its size at the present share for one weight."""
    wide = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    return F.col("weight") * wide(num) < F.col("source_size") * wide(most * under * free_weight)


def _draw_bits(doc_id: Column, text: Column) -> Column:
    """A document's hash as a number below the modulus: of its id, or of its text where the id is null."""
    key = F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") % _MODULUS


def _drawn(bits: Column, draw: Column, fraction: Column) -> Column:
    """Whether a draw falls under ``fraction``. Each multiplies the hash by its own number: fair, and independent over documents."""
    return (bits * (draw * _STRIDE + 1) % _MODULUS).cast("double") < fraction * float(_MODULUS)


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``bits`` of every document: all that the mix is reckoned from."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text").cast("string")).alias("size"), _draw_bits(F.col("doc_id"), F.col("text")).alias("bits"),
    )


def _rated(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A plain join of two written tables: Spark broadcasts the targets where they are small, and splits a hot source where not."""
    theirs = targets.withColumnRenamed("source", "its_source")
    return sizes.join(theirs, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")


def mixing_rates(sizes: DataFrame, draws: int = DRAWS, **shares) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``draw`` of every source; ``sizes`` is a written :func:`sized`.

    Every draw gives each document its copy with the same probability. One draw
    of a source with few or very long documents may miss the target by far, so
    each source takes the one of ``draws`` (at most 64) that comes nearest, the first
    of equals. Their sums are one aggregate, combined before the shuffle.
    """
    targets = stage(source_targets(sizes.select("source", "size"), **shares), "source-targets")
    whole, fraction = F.floor(_rate()), _rate() - F.floor(_rate())
    sums = [F.sum(F.when(_drawn(F.col("bits"), F.lit(j).cast("long"), F.col("fraction")), F.col("size")).otherwise(0)).alias(f"s{j}") for j in range(draws)]
    taken = _rated(sizes, targets).withColumn("fraction", fraction).groupBy("source").agg(*sums)
    targets = _rated(taken, targets)
    missed = [F.struct(F.abs((whole * F.col("source_size") + F.col(f"s{j}")).cast("double") - F.col("target")).alias("by"), F.lit(j).cast("long").alias("draw")) for j in range(draws)]
    return targets.select("source", "source_size", "target", F.array_min(F.array(*missed))["draw"].alias("draw"))


def _copies() -> Column:
    """Copies of a document from its ``bits`` and its source's rate and ``draw``."""
    whole = F.floor(_rate())
    return (whole + F.when(_drawn(F.col("bits"), F.col("draw"), _rate() - whole), 1).otherwise(0)).cast("int")


def copies(sizes: DataFrame, rates: DataFrame) -> DataFrame:
    """Every document of ``sizes`` with ``source_size``, ``target`` and ``copies``, how often the mix takes it."""
    return _rated(sizes, rates).select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))


def mix(docs: DataFrame, rates: DataFrame | None = None, **shares) -> DataFrame:
    """The mixed documents: every row of ``docs``, columns as they are, as often as the mix takes it.

    ``docs`` has ``doc_id``, ``source`` and ``text``. A null source is a source
    of its own and comes last; a null text has no words but is emitted by its
    source's rate. Repeated rows are documents of their own that share a draw;
    rows with a null id draw by their text. A source without words is left out,
    and an empty table gives an empty mix. Draws come from hashes, so reruns and
    retried tasks agree.
    """
    prepare(docs.sparkSession)
    if rates is None:
        rates = mixing_rates(stage(sized(docs), "sizes"), **shares)
    rates = stage(rates, "mixing-rates")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    row = docs.select(whole, F.col("source").cast("string").alias("source"), _draw_bits(F.col("doc_id"), F.col("text")).alias("bits"))
    taken = _rated(row, rates).select("row", F.explode(F.array_repeat(F.lit(0), _copies())))
    return taken.select("row.*")
