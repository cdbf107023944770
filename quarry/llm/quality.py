"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

All row work is DataFrame functions. A rule reads a feature column and votes good (1), bad (-1)
or nothing (0). Bad documents are bad in different ways, which two classes of independent votes
don't fit, so the latent classes are one good class and a failure mode for each rule. Documents
with the same votes are alike to the model: only the counts of vote patterns (at most 3 ** rules
rows, whatever the corpus) reach the expectation-maximisation loop.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, whole

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds and bad does not, else abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "n_symbols > 0.1D * n_words", "n_symbols <= 0.05D * n_words"),
    Rule("lines", "n_dup_lines > 0.5D * n_lines", "n_dup_lines <= 0.4D * n_lines"),
    Rule("repeats", "n_repeat_words > 0.4D * n_words", "n_repeat_words <= 0.35D * n_words"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words", "word_chars BETWEEN 3.5D * n_words AND 7 * n_words"),
    Rule("capitals", "n_capitals > 0.3D * word_chars", "n_capitals <= 0.2D * word_chars"),
    Rule("exclamations", "n_exclaims > 0.3D * n_words", "n_exclaims <= 0.1D * n_words"),
    Rule("variety", "n_distinct < 0.2D * n_words", "n_distinct >= 0.3D * n_words"),
)

#: The good class; the failure modes are named after their rules.
GOOD = ""

#: A rule votes bad on at most this share of good documents; it keeps the good class apart.
MOST_WRONG = 0.005


@dataclass(frozen=True)
class Model:
    """Shares of the classes, and by class and rule the chances of the votes -1, 0 and 1."""

    share: dict[str, float]
    chance: dict[str, dict[str, dict[int, float]]]

    def scores(self, cast: dict[str, int]) -> dict[str, float]:
        """Log of share times chance of these votes, by class."""
        return {c: math.log(w) + sum(math.log(self.chance[c][n][v]) for n, v in cast.items()) for c, w in self.share.items()}


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules read.

    Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals,
    n_exclaims, n_distinct (all long). A null text has no words. n_repeat_words counts the words
    in three-word windows found twice or more in their text; windows are told apart by their
    64-bit hashes. Work columns start with ``_q_``; the added names replace columns of that name.
    """
    d = docs.withColumn("_q_text", whole(text))
    d = d.withColumn("_q_words", F.array_remove(F.split("_q_text", SPACE), ""))
    d = d.withColumn("_q_n", F.size("_q_words"))
    d = d.withColumn("_q_lines", F.expr(r"filter(split(_q_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn("_q_windows", F.expr("slice(transform(_q_words, (w, i) -> xxhash64(w, get(_q_words, i + 1), get(_q_words, i + 2))), 1, greatest(_q_n - 2, 0))"))
    d = d.withColumn("_q_sorted", F.expr("CASE WHEN size(array_distinct(_q_windows)) < size(_q_windows) THEN sort_array(transform(_q_windows, (h, i) -> struct(h AS h, i AS i))) END"))
    d = d.withColumn("_q_twice", F.expr("filter(_q_sorted, (x, k) -> coalesce(x.h = get(_q_sorted, k - 1).h, false) OR coalesce(x.h = get(_q_sorted, k + 1).h, false))"))
    d = d.withColumn("_q_places", F.expr("sort_array(transform(_q_twice, x -> x.i))"))
    counted = {
        "n_words": F.col("_q_n"),
        "word_chars": F.length(F.regexp_replace("_q_text", SPACE, "")),
        "n_symbols": F.regexp_count("_q_text", F.lit(SYMBOLS)),
        "n_lines": F.size("_q_lines"),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": F.expr("coalesce(aggregate(transform(_q_places, (p, k) -> least(3, coalesce(get(_q_places, k + 1) - p, 3))), 0, (a, x) -> a + x), 0)"),
        "n_capitals": F.length(F.regexp_replace("_q_text", r"[^\p{Lu}]+", "")),
        "n_exclaims": F.regexp_count("_q_text", F.lit("!")),
        "n_distinct": F.size(F.array_distinct("_q_words")),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in counted]
    return d.select(*kept, *[v.cast("long").alias(k) for k, v in counted.items()])


def base_failed() -> Column:
    """The hard rule beside the model: under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    return [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"_v_{r.name}") for r in rules]


def fit(counted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 60, smoothing: float = 0.5) -> Model:
    """Estimate the rules' accuracies by class from their votes on all rows, without labels.

    ``counted`` has the columns of ``features``. Votes are taken as independent given the class.
    At the start the good class is trusted to get few bad votes, and each failure mode to get its
    own rule's bad vote. That good documents get bad votes in at most ``MOST_WRONG`` of the cases is
    a prior that every round keeps. An empty table gives the start.
    """
    return _fit(counted.select(*votes(rules)), [r.name for r in rules], rounds, smoothing)


def _fit(cast: DataFrame, names: list[str], rounds: int = 60, smoothing: float = 0.5) -> Model:
    """``fit`` for votes already cast, in the columns ``_v_`` and the rule's name."""
    rows = cast.groupBy(*[f"_v_{n}" for n in names]).count().collect()
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in rows)
    start = {True: {-1: 0.8, 0: 0.15, 1: 0.05}, False: {-1: 0.1, 0: 0.3, 1: 0.6}}
    chance = {c: {n: start[n == c] for n in names} for c in names} | {GOOD: {n: {-1: 0.005, 0: 0.295, 1: 0.7} for n in names}}
    model = Model({c: 0.5 if c == GOOD else 0.5 / len(names) for c in chance}, chance)
    for _ in range(rounds if patterns else 0):
        tallies = {c: {n: {v: smoothing for v in (-1, 0, 1)} for n in names} for c in chance}
        weight = dict.fromkeys(chance, smoothing)
        for pattern, count in patterns:
            for c, p in posteriors(model, dict(zip(names, pattern, strict=True))).items():
                weight[c] += p * count
                for n, v in zip(names, pattern, strict=True):
                    tallies[c][n][v] += p * count
        chance = {c: {n: {v: x / sum(t.values()) for v, x in t.items()} for n, t in tallies[c].items()} for c in chance}
        for n, t in chance[GOOD].items():
            if t[-1] > MOST_WRONG:
                chance[GOOD][n] = {v: MOST_WRONG if v == -1 else x * (1 - MOST_WRONG) / (1 - t[-1]) for v, x in t.items()}
        model = Model({c: w / sum(weight.values()) for c, w in weight.items()}, chance)
    return model


def posteriors(model: Model, cast: dict[str, int]) -> dict[str, float]:
    """The chance of each class for a document with these votes."""
    scores = model.scores(cast)
    top = max(scores.values())
    raised = {c: math.exp(x - top) for c, x in scores.items()}
    return {c: x / sum(raised.values()) for c, x in raised.items()}


def score(counted: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``counted`` with quality (the posterior chance of the good class), as plain column arithmetic."""
    return counted.withColumn("quality", _posterior(dict(zip([r.name for r in rules], votes(rules), strict=True)), model))


def _posterior(cast: dict[str, Column], model: Model) -> Column:
    total = F.lit(1.0)
    for c in model.share:
        if c != GOOD:
            against = F.lit(math.log(model.share[c] / model.share[GOOD]))
            for n, vote in cast.items():
                odds = {v: F.lit(math.log(model.chance[c][n][v] / model.chance[GOOD][n][v])) for v in (-1, 0, 1)}
                against = against + F.when(vote == -1, odds[-1]).when(vote == 1, odds[1]).otherwise(odds[0])
            total = total + F.exp(F.least(against, F.lit(500.0)))
    return 1 / total


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with its counts, base_failed, quality and kept; the text column is left out.

    kept is false where the base rule fails, else whether quality reaches ``threshold``. The
    counts are written once to scratch: the model is fitted on them and then applied to them.
    Null and empty texts have no words and fail; repeated rows are judged alike; an empty table
    gives no rows.
    """
    counted = materialize(features(docs, text).drop(text))
    scored = score(counted, fit(counted, rules), rules)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the base rule and the model keep, with their own columns.

    The counts are made once: the rows are written to scratch with their votes, on which the model
    is fitted and by which they are then kept. Nothing is shuffled.
    """
    names = [f"_v_{r.name}" for r in rules]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    cast = materialize(features(packed, "_text").select("_row", *votes(rules), base_failed().alias("_base")))
    model = _fit(cast.select(*names), [r.name for r in rules])
    posterior = _posterior({r.name: F.col(f"_v_{r.name}") for r in rules}, model)
    return cast.where(~F.col("_base") & (posterior >= threshold)).select("_row.*")
