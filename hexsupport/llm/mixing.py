"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic); the cells' weights are raked to
the target shares of each of the three in turn until all fit. A document is
then kept with a probability in proportion to its cell's weight over its
tokens, calibrated so that the kept tokens are expected to reach the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexsupport.llm.store import Workspace, unused

DIMENSIONS = ("source", "lang", "topic")
#: Cells that are raked on the driver and broadcast to the texts (some 100 bytes each); more are raked as a table and joined by shuffling.
DRIVER_CELLS = 50_000
ROUNDS, CLOSE = 200, 1e-9


def words(text: Column) -> Column:
    """The number of words, as token count."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from a text's form, for tables without a topic column."""
    return (
        F.when(text.isNull() | (F.length(text) < 400), "brief")
        .when(text.contains("@") | text.contains("+1 ("), "contact")
        .when(text.contains(" | "), "table")
        .when(text.contains("icense"), "licensed")
        .otherwise("prose")
    )


def tempered(cells: list[tuple], power: float = 0.7) -> list[dict]:
    """Target shares of each dimension: its share of the tokens to a power under 1, so that rare values gain."""
    found = []
    for k in range(len(DIMENSIONS)):
        total: dict = {}
        for cell in cells:
            total[cell[k]] = total.get(cell[k], 0) + cell[-1]
        raised = {v: t**power for v, t in total.items() if t > 0}
        whole = sum(raised.values())
        found.append({v: r / whole for v, r in raised.items()})
    return found


def _key(cell) -> tuple:
    return tuple((v is not None, str(v)) for v in cell[:3])


def reachable(cells: list[tuple], targets: list[dict]) -> list[dict]:
    """The targets whose value has tokens in a cell, scaled to sum to 1."""
    goals = []
    for k, wanted in enumerate(targets):
        there = {c[k] for c in cells if c[3] > 0}
        whole = sum(s for v, s in wanted.items() if v in there)
        goals.append({v: s / whole for v, s in wanted.items() if v in there} if whole else {})
    return goals


def missed(cells: list[tuple], tokens: list[float], goals: list[dict]) -> float:
    """The largest difference between a value's share of ``tokens``, given by cell, and its goal; 0 without tokens."""
    worst = 0.0
    for k, goal in enumerate(goals):
        total: dict = {}
        for c, t in zip(cells, tokens, strict=True):
            total[c[k]] = total.get(c[k], 0.0) + t
        whole = sum(total.values())
        worst = max([worst, *(abs(t / whole - goal.get(v, 0.0)) for v, t in total.items() if whole)])
    return worst


def rake(cells: list[tuple], targets: list[dict], rounds: int = ROUNDS) -> tuple[list[float], float]:
    """(weights of the cells, summing to 1; largest misfit of a share) for (source, lang, topic, tokens) cells.

    Targets without a cell are left out and the rest scaled; cells without a target get 0.
    """
    weight = [float(c[3]) for c in cells]
    goals = reachable(cells, targets)
    misfit = 1.0
    for _ in range(rounds):
        misfit = 0.0
        for k, goal in enumerate(goals):
            total: dict = {}
            for c, w in zip(cells, weight, strict=True):
                total[c[k]] = total.get(c[k], 0.0) + w
            whole = sum(total.values()) or 1.0
            misfit = max([misfit, *(abs(t / whole - goal.get(v, 0.0)) for v, t in total.items())])
            weight = [w * goal.get(c[k], 0.0) / total[c[k]] if total[c[k]] else 0.0 for c, w in zip(cells, weight, strict=True)]
        if misfit < CLOSE:
            break
    whole = sum(weight)
    return [w / whole if whole else 0.0 for w in weight], misfit


def calibrate(tokens: list[int], weight: list[float], budget: float) -> list[float]:
    """Keep probabilities in proportion to weight / tokens, at most 1, whose expected tokens reach the budget as far as cells allow."""
    rate = [w / t if t else 0.0 for t, w in zip(tokens, weight, strict=True)]
    full: set[int] = set()
    while True:
        free = [i for i in range(len(rate)) if i not in full and rate[i] > 0]
        left, open_ = budget - sum(tokens[i] for i in full), sum(tokens[i] * rate[i] for i in free)
        scale = max(left, 0.0) / open_ if open_ else 0.0
        over = {i for i in free if rate[i] * scale >= 1}
        if not over:
            return [1.0 if i in full else rate[i] * scale for i in range(len(rate))]
        full |= over


def _rake_table(cells: DataFrame, power: float, given: dict, budget_share: float, ws: Workspace, rounds: int) -> DataFrame:
    """``rake`` and ``calibrate`` as joins and sums, for more cells than the driver takes."""
    cells = ws.write(cells.withColumn("weight", F.col("tokens").cast("double")))
    goals = {}
    for d in DIMENSIONS:
        if d in given:
            goal = cells.sparkSession.createDataFrame([(v, float(s)) for v, s in given[d].items()], f"{d}_ string, share double")
            there = cells.filter("tokens > 0").select(d).distinct()
            goal = there.join(goal, there[d].eqNullSafe(goal[f"{d}_"])).select(d, "share")
        else:
            goal = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), power).alias("share")).filter("share > 0")
        whole = goal.agg(F.sum("share")).first()[0] or 1.0
        goals[d] = ws.write(goal.select(F.col(d).alias(f"{d}_"), (F.col("share") / whole).alias("goal")))
    for _ in range(rounds):
        misfit = 0.0
        for d in DIMENSIONS:
            total = cells.groupBy(d).agg(F.sum("weight").alias("total"))
            factor = ws.write(total.join(goals[d], total[d].eqNullSafe(goals[d][f"{d}_"]), "left").select(F.col(d).alias("v"), "total", F.coalesce("goal", F.lit(0.0)).alias("goal")))
            whole = factor.agg(F.sum("total")).first()[0] or 1.0
            misfit = max(misfit, factor.agg(F.max(F.abs(F.col("total") / whole - F.col("goal")))).first()[0] or 0.0)
            fitted = cells.join(factor, cells[d].eqNullSafe(factor["v"])).withColumn("weight", F.when(F.col("total") > 0, F.col("weight") * F.col("goal") / F.col("total")).otherwise(0.0))
            before, cells = cells, ws.write(fitted.select(*DIMENSIONS, "tokens", "weight"))
            ws.drop(before, factor)
        if misfit < CLOSE:
            break
    sums = cells.agg(F.sum("weight"), F.sum("tokens")).first()
    cells = cells.withColumn("weight", F.col("weight") / (sums[0] or 1.0)).withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    budget, scale = budget_share * (sums[1] or 0), 0.0
    while True:  # the set of cells kept in full only grows
        full = (F.col("rate") * scale >= 1) & (F.col("rate") > 0)
        got = cells.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("rate"))), F.lit(0.0))).first()
        now = max(budget - got[0], 0.0) / got[1] if got[1] else scale
        if now <= scale * (1 + 1e-12):
            break
        scale = now
    cells = cells.select(*DIMENSIONS, "tokens", "weight", F.least(F.lit(1.0), F.col("rate") * scale).alias("probability"))
    misfit, kept = 0.0, F.col("tokens") * F.col("probability")
    whole = cells.agg(F.sum(kept)).first()[0]
    for d in DIMENSIONS if whole else ():
        share = cells.groupBy(d).agg((F.sum(kept) / whole).alias("share"))
        gap = share.join(goals[d], share[d].eqNullSafe(goals[d][f"{d}_"]), "left").agg(F.max(F.abs(F.col("share") - F.coalesce("goal", F.lit(0.0)))))
        misfit = max(misfit, gap.first()[0] or 0.0)
    return cells.withColumn("misfit", F.lit(misfit))


def cell_rates(rows: DataFrame, ws: Workspace, targets: dict | None = None, budget_share: float = 0.75, power: float = 0.7, driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability, misfit) of every cell of ``rows(source, lang, topic, n_tokens)``; those of up to ``driver_cells`` are to be broadcast."""
    spark, targets = rows.sparkSession, targets or {}
    cells = ws.write(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    found = cells.limit(driver_cells + 1).collect()
    if len(found) > driver_cells:
        return _rake_table(cells, power, targets, budget_share, ws, rounds)
    found = sorted((tuple(r) for r in found), key=_key)
    even = tempered(found, power)
    wanted = [targets.get(d, even[k]) for k, d in enumerate(DIMENSIONS)]
    weight, _ = rake(found, wanted, rounds)
    chance = calibrate([c[3] for c in found], weight, budget_share * sum(c[3] for c in found))
    misfit = missed(found, [c[3] * p for c, p in zip(found, chance, strict=True)], reachable(found, wanted))
    rates = [(*c, w, p, misfit) for c, w, p in zip(found, weight, chance, strict=True)]
    return F.broadcast(spark.createDataFrame(rates, "source string, lang string, topic string, tokens long, weight double, probability double, misfit double"))


def draw(df: DataFrame, id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the row's id alone (a null id: on its text)."""
    h = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.when(F.col(f"`{id_col}`").isNull(), F.col(f"`{text_col}`")))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def mixed(documents: DataFrame, topic_col: str | None = None, targets: dict | None = None, budget_share: float = 0.75, power: float = 0.7, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``documents`` with ``topic``, ``n_tokens``, ``weight`` (its cell's), ``probability``, ``misfit`` and ``kept``.

    ``targets`` gives shares by value for any of source, lang and topic; the
    others get tempered shares. ``budget_share`` of all tokens are to be kept;
    ``n_tokens`` counts words. ``misfit`` is the largest difference between a
    value's share of the tokens that are expected to be kept and its target. It
    is about 0 where the targets can be reached; it is not where they contradict
    each other or the cells, or where the budget is more than they allow: a cell
    kept in full (probability 1) then has less than its target share, and the
    others take up what it lacks. A smaller ``budget_share`` lowers it.
    Defined results: a null source, language or topic is a value of its own; a
    null or wordless text has 0 tokens and, in a cell without tokens, is not
    kept; cells without a target share are not kept; rows with equal ids are
    kept or not together; texts of any length count whole; columns of the names
    of the results (in any case) are replaced (``topic`` only where ``topic_col``
    is None). An empty table gives an empty one.
    """
    ws = Workspace(documents.sparkSession, "mixing")
    drop = {"n_tokens", "weight", "probability", "misfit", "kept"} | ({"topic"} if (topic_col or "").lower() != "topic" else set())
    text = F.col(f"`{text_col}`")
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in drop]
    label = topic(text) if topic_col is None else F.col(f"`{topic_col}`").cast("string")
    rows = documents.select(*kept, *([] if "topic" not in drop else [label.alias("topic")]), words(text).alias("n_tokens"))
    rates = cell_rates(rows.select(*(F.col(d).cast("string").alias(d) for d in DIMENSIONS), "n_tokens"), ws, targets, budget_share, power, driver_cells)
    own = dict(zip(DIMENSIONS, unused(rows, *DIMENSIONS), strict=True))
    rates = rates.select(*(F.col(d).alias(name) for d, name in own.items()), "weight", "probability", "misfit")
    same = [rows[d].cast("string").eqNullSafe(rates[name]) for d, name in own.items()]
    out = rows.join(rates, same[0] & same[1] & same[2], "left").drop(*own.values())
    return out.withColumn("kept", F.coalesce(draw(out, id_col, text_col, seed) < F.col("probability"), F.lit(False)))
