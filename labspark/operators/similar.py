"""The most similar entry of a large list for every text, exactly, without comparing all pairs.

A scorer comes with two safe bounds. Lengths bound the score, and a score of at least t needs a least number of
shared grams. With the grams of every text sorted rarest first, two texts that share so many must meet
within the first ones of both (the prefix), so an equi-join of prefix grams finds every pair that reaches t.
Rounds of falling t take only those texts whose best score so far is below the last t; their prefixes get longer.
Texts that reach no t meet the entries of the lengths that could still beat their best score, by length and part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.names import matching_block_ratio, similarity
from labspark.tables import numbered, written

Scorer = Callable[[Column, Column], Column]
#: Falling scores of the rounds.
ROUNDS = (0.7,)
#: Parts of the entries of one length in the last round, so that no task holds them all.
PARTS = 8
_SLACK = 1e-9
#: By how much a score that was packed into a number may lie below itself, and more.
_NEAR = 2e-9


@dataclass(frozen=True)
class BoundedScorer:
    """A score of two texts with what bounds it.

    ``grams`` gives a text's grams with repetitions; ``shared`` the least number of them that two texts
    of these lengths share at score t; ``shared_any`` the same for one length and any other; ``most`` the highest
    score that lengths allow.
    """

    score: Scorer
    grams: Callable[[Column], Column]
    shared: Callable[[Column, Column, float], Column]
    shared_any: Callable[[Column, float], Column]
    most: Callable[[Column, Column], Column]


def _letters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _letter_pairs(text: Column) -> Column:
    """Pairs of neighbours, the ends counting as neighbours of a mark: one more than there are letters."""
    padded = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(padded, i, F.lit(2)))


#: One edit spoils at most two padded pairs of the longer text, which has length + 1 of them. Valid from 0.5 on.
EDIT = BoundedScorer(
    similarity, _letter_pairs,
    lambda a, b, t: F.ceil(1 + F.greatest(a, b) * (2 * t - 1) - _SLACK),
    lambda a, t: F.ceil(1 + a * (2 * t - 1) - _SLACK),
    lambda a, b: F.least(a, b) / F.greatest(a, b))
#: Matching blocks hold at most the letters that both texts have.
BLOCKS = BoundedScorer(
    matching_block_ratio, _letters,
    lambda a, b, t: F.ceil((a + b) * (t / 2) - _SLACK),
    lambda a, t: F.ceil(a * (t / (2 - t)) - _SLACK),
    lambda a, b: 2 * F.least(a, b) / (a + b))


def bounded(scorer: Scorer | BoundedScorer) -> tuple[BoundedScorer, Sequence[float]]:
    """The scorer with its bounds and rounds; one without known bounds has neither and sees all pairs."""
    if isinstance(scorer, BoundedScorer):
        return scorer, ROUNDS
    for known in (EDIT, BLOCKS):
        if known.score is scorer:
            return known, ROUNDS
    return BoundedScorer(scorer, _letters, lambda a, b, t: F.lit(0), lambda a, t: F.lit(0), lambda a, b: F.lit(1e300)), ()


def _elements(text: Column, scorer: BoundedScorer) -> Column:
    """Hashed grams, the second, third ... occurrence of one gram being elements of their own."""
    grams = scorer.grams(text)
    return F.transform(grams, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda h: h == g))))


def _rarest_first(rows: DataFrame, key: list[str], counts: DataFrame) -> DataFrame:
    """Replace ``elements`` by the array sorted by (number of entries that hold it, element)."""
    # outer: no text is without elements, and no filter that computes them again is put before this
    return (
        rows.withColumn("element", F.explode_outer("elements")).drop("elements").join(counts, "element", "left")
        .groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(
            F.coalesce("held", F.lit(0)).alias("held"), "element"))), lambda s: s["element"]).alias("elements")))


def _packed(score: Column) -> Column:
    """Score and entry as one number that orders by score, then by the earlier entry: a plain maximum stays in a hash table.

    Scores are told apart to 2 ** -31, which is exact for both scorers up to some 20,000 letters.
    """
    return F.shiftleft(F.floor(score * (1 << 31)).cast("long"), 31) + F.lit((1 << 31) - 1) - F.col("entry")


def best_matches(names: DataFrame, index: DataFrame, scorer: Scorer | BoundedScorer = EDIT) -> DataFrame:
    """(raw_name, best) for names (raw_name, cleaned): the entry of the highest score, ties to the earlier one.

    ``index`` has alias, standard_name and alias_ord, each alias once, two billion at most. ``best`` holds score, alias and
    standard. No names or no entries: no rows. Texts and entries must not be empty. Names, entries and the result of each
    round are written; pairs carry numbers and the two texts only, and are reduced before they are shuffled.
    """
    scorer, rounds = bounded(scorer)
    listed = index.select("alias", F.col("standard_name").alias("standard"), "alias_ord.*", F.char_length("alias").alias("m"),
                          _elements(F.col("alias"), scorer).alias("elements"))
    counts = listed.select(F.explode_outer("elements").alias("element")).groupBy("element").agg(
        F.count(F.lit(1)).alias("held"))
    entries = written(numbered(_rarest_first(listed, ["alias", "standard", "ord", "i", "k", "m"], counts).withColumnRenamed(
        "elements", "theirs"), [F.col(c) for c in ("ord", "i", "k", "alias")], "entry"), "entries")
    asked = names.select("raw_name", "cleaned", F.char_length("cleaned").alias("n"),
                         _elements(F.col("cleaned"), scorer).alias("elements"))
    texts = numbered(_rarest_first(asked, ["raw_name", "cleaned", "n"], counts), [F.col("raw_name")], "text")

    found = names.sparkSession.createDataFrame([], "text long, best long")
    known = F.shiftright("best", 31) / F.lit(float(1 << 31))
    for last, t in zip([1.1, *rounds], rounds, strict=False):
        open_ = texts.join(found.where(known >= last - _NEAR), "text", "left_anti")  # what has reached the last t is done
        asked = open_.select("*", F.posexplode(F.slice("elements", F.lit(1), F.greatest(
            F.lit(0), F.size("elements") - scorer.shared_any(F.col("n"), t).cast("int") + 1))).alias("place", "element"))
        posted = entries.select("*", F.posexplode(F.slice("theirs", F.lit(1), F.greatest(
            F.lit(0), F.size("theirs") - scorer.shared_any(F.col("m"), t).cast("int") + 1))).alias("at", "element"))
        left = F.least(F.size("elements") - F.col("place"), F.size("theirs") - F.col("at"))
        met = asked.join(posted, "element").where(
            (scorer.most(F.col("n"), F.col("m")) >= t - _SLACK)
            & (left >= scorer.shared(F.col("n"), F.col("m"), t))
            # a pair counts where its first common element meets
            & ~F.arrays_overlap(F.slice("elements", F.lit(1), F.col("place")), F.slice("theirs", F.lit(1), F.col("at"))))
        found = _merged(found, met.select("text", "entry", "cleaned", "alias"), scorer, f"found-{t}")

    lengths = entries.agg(F.array_sort(F.collect_set("m"))).scalar()  # as many numbers as lengths occur
    so_far = F.coalesce(known, F.lit(0.0))
    low = min(rounds, default=1.1)
    open_ = texts.select("text", "cleaned", "n").join(found, "text", "left").where(so_far < low - _NEAR)
    reach = F.filter("lengths", lambda m: scorer.most(F.col("n"), m) >= so_far - _NEAR)
    # names are dealt to parts, and the entries, of one length each, go to every part
    asked = open_.withColumn("lengths", lengths).select(
        "text", "cleaned", F.pmod("text", F.lit(PARTS)).cast("int").alias("part"), F.explode(reach).alias("m"))
    dealt = entries.select("entry", "alias", "m", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    best = _merged(found, asked.join(dealt, ["m", "part"]).select("text", "entry", "cleaned", "alias"), scorer, "best")
    chosen = best.join(texts.select("text", "raw_name", "cleaned"), "text").withColumn(
        "entry", F.lit((1 << 31) - 1) - F.col("best").bitwiseAND((1 << 31) - 1)).join(
        entries.select("entry", "alias", "standard"), "entry")
    return chosen.select("raw_name", F.struct(scorer.score(F.col("cleaned"), F.col("alias")).cast("double").alias("score"),
                                              "alias", "standard").alias("best"))


def _merged(found: DataFrame, pairs: DataFrame, scorer: BoundedScorer, name: str) -> DataFrame:
    """(text, best) of what was found before and of the new pairs, as a written table."""
    new = pairs.select("text", _packed(scorer.score(F.col("cleaned"), F.col("alias"))).alias("best"))
    return written(found.unionByName(new).groupBy("text").agg(F.max("best").alias("best")), name)
