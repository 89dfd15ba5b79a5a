"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic) cell; the cells' weights are
raked until the three marginals meet their targets; documents are sampled by a
hash of their id with probability proportional to their cell's factor.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, salted_lookup

MARGINS = ("source", "lang", "topic")
#: Up to this many cells (some 10 MB) are raked on the driver, more as Spark jobs.
DRIVER_CELLS = 100_000


def layout_topic(text: Column) -> Column:
    """A topic from the text's own layout: table, marked, shouted, short or prose."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    return (
        F.when(share("|") > 0.02, "table")
        .when(share("#$%&*") > 0.05, "marked")
        .when(share("!") > 0.05, "shouted")
        .when(n < 400, "short")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of one marginal: observed shares to a power, made to sum to 1."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).select(margin, F.pow(F.col("t").cast("double"), F.lit(power)).alias("t"))
    total = own.agg(F.sum("t")).first()[0] or 1.0
    return own.select(margin, (F.col("t") / total).alias("target"))


def stated(cells: DataFrame, margin: str, shares: dict[str, float], power: float) -> DataFrame:
    """Target shares of one marginal from ``shares``; values that it doesn't name share what is left, tempered.

    Shares are of all tokens and sum to 1 at most.  Those of values without tokens
    can't be met: the others are scaled up.
    """
    if min(shares.values(), default=0) < 0 or sum(shares.values()) > 1 + 1e-9:
        raise ValueError(f"shares of {margin} must not be negative and sum to 1 at most")
    spark = cells.sparkSession
    table = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "named string, share double")
    own = tempered(cells, margin, power).join(F.broadcast(table), F.col(margin) == F.col("named"), "left")
    rest = max(0.0, 1 - sum(shares.values()))
    other, found = own.agg(F.sum(F.when(F.col("named").isNull(), F.col("target"))), F.sum("share")).first()
    total = (found or 0.0) + (rest if other else 0.0)
    if not total:
        raise ValueError(f"no value of {margin} that has tokens has a share")
    share = F.coalesce("share", F.col("target") * (rest / other if other else 0.0)) / total
    return own.select(margin, share.alias("target"))


def _goes_on(errors: list[float], rounds: int | None, tolerance: float) -> bool:
    """Whether another round is due: until the tolerance, or until a hundred rounds bring next to nothing."""
    if errors and errors[-1] < tolerance:
        return False
    if rounds is not None:
        return len(errors) < rounds
    return len(errors) <= 100 or errors[-1] < 0.99 * errors[-101]


def _report(errors: list[float], tolerance: float) -> None:
    if errors and errors[-1] >= tolerance:
        warnings.warn(f"raking left a marginal share {errors[-1]:.3g} off its target after {len(errors)} rounds", stacklevel=3)


def rake_driver(rows: list[tuple], targets: list[dict], rounds: int | None, tolerance: float) -> dict[tuple, float]:
    """Factor of each cell from (source, lang, topic, tokens) rows."""
    import numpy as np

    tokens = np.array([r[3] for r in rows], float)
    weight = tokens / tokens.sum()
    codes, goals = [], []
    for i, target in enumerate(targets):
        names = sorted({r[i] for r in rows})
        at = {v: k for k, v in enumerate(names)}
        codes.append(np.array([at[r[i]] for r in rows]))
        goals.append(np.array([target[v] for v in names]))
    errors: list[float] = []
    while _goes_on(errors, rounds, tolerance):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, weight, len(goal))
            worst = max(worst, float(np.abs(now - goal).max()))
            weight = weight * (goal / np.maximum(now, 1e-300))[code]
        errors.append(worst)
    _report(errors, tolerance)
    return {r[:3]: w * float(tokens.sum()) / t for r, w, t in zip(rows, weight.tolist(), tokens.tolist(), strict=True)}


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None, tolerance: float = 1e-9, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, tokens, factor): tokens * factor meets the targets' shares of all tokens.

    Without ``rounds`` it goes on until the tolerance is met.  Sparse cells may
    have no solution: it stops where a hundred rounds take less than 1% off the
    worst error, and a warning tells the error left.
    """
    spark = cells.sparkSession
    filled = cut(cells.where("tokens > 0"))
    if filled.limit(driver_cells + 1).count() <= driver_cells:
        rows = [(r.source, r.lang, r.topic, r.tokens) for r in filled.collect()]
        if not rows:
            return filled.withColumn("factor", F.lit(1.0))
        goals = [{r[0]: r[1] for r in targets[m].collect()} for m in MARGINS]
        found = rake_driver(rows, goals, rounds, tolerance)
        return spark.createDataFrame([(*r, found[r[:3]]) for r in rows], "source string, lang string, topic string, tokens long, factor double")
    total = filled.agg(F.sum("tokens")).first()[0]
    now = filled.withColumn("factor", F.lit(1.0))
    errors: list[float] = []
    while _goes_on(errors, rounds, tolerance):
        worst = 0.0
        for m in MARGINS:
            share = now.groupBy(m).agg((F.sum(F.col("tokens") * F.col("factor")) / total).alias("share")).join(targets[m], m)
            now = cut(salted_lookup(now, share, [m], F.struct(*MARGINS)).withColumn("factor", F.col("factor") * F.col("target") / F.col("share")))
            worst = max(worst, now.agg(F.max(F.abs(F.col("share") - F.col("target")))).first()[0])
            now = now.drop("share", "target")
        errors.append(worst)
    _report(errors, tolerance)
    return now


def mix(
    docs: DataFrame,
    power: float = 0.95,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, factor, probability, sampled.

    ``targets`` states shares of tokens by margin ("source", "lang", "topic") and
    value, such as ``{"lang": {"en": 0.5}}``; see ``stated``.  Margins that it leaves
    out aim at their observed shares to the power ``power``.

    Probabilities are the raked factors over the largest one, so expected tokens
    meet the target marginals to 1e-9 of all tokens, or, where the cells allow no
    solution, as far as a warning tells.  Null sources and languages form the
    group ''; texts without words count no tokens, carry no weight and get the
    smallest probability of their corpus; texts of any length are counted whole;
    rows that repeat an id share its draw;
    an empty table gives an empty result; clashing extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        (layout_topic(text) if topic is None else topic).alias("topic"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
    )
    rows = cut(rows)
    cells = rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    goals = targets or {}
    if set(goals) - set(MARGINS):
        raise ValueError(f"targets are by {', '.join(MARGINS)}")
    filled = cells.where("tokens > 0")
    aims = {m: stated(filled, m, goals[m], power) if goals.get(m) and filled.head(1) else tempered(cells, m, power) for m in MARGINS}
    factors = rake(cells, aims)
    ends = factors.agg(F.max("factor").alias("most"), F.min("factor").alias("least")).first()
    most, least = (ends.most or 1.0), (ends.least or 1.0)
    found = salted_lookup(rows, factors.select(*MARGINS, "factor"), list(MARGINS), F.col("doc_id"), 32)
    factor = F.coalesce("factor", F.lit(least))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return found.select(
        "doc_id", *MARGINS, "tokens", factor.alias("factor"), (factor / most).alias("probability"), (draw < factor / most).alias("sampled")
    )
