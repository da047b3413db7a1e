"""Quality rules by weak supervision, in built-in functions only.

Each rule votes for good (1) or bad (-1) or abstains (0) on a text's measures.
Texts are counted by their votes: at most ``3 ** len(rules())`` patterns, whatever
the number of texts. Expectation-maximisation over the patterns estimates each
rule's votes given good and given bad (Dawid and Skene, 1979) and the share of
good texts. A text's posterior probability of being good decides, instead of
requiring it to pass every rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexsupport.llm.store import Workspace, set_aside

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Measures beyond the base ones.
MORE = ("n_lines", "n_ended", "n_kinds", "n_symbol_runs", "n_symbol_lines")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
INNER = ("_text", "_words", "_lines", "_h", "_mask", "_hits")
ENDS = r"[.!?…:;\"'»”)]\s*$"


def _when(good: Column, bad: Column) -> Column:
    return F.coalesce(F.when(bad, -1).when(good, 1).otherwise(0), F.lit(0))


def rules() -> dict[str, Column]:
    """The votes by name, from the columns of ``measures``."""
    n, c = F.col("n_words"), F.col("word_chars")
    lines, some = F.col("n_lines"), F.col("n_words") >= 10
    return {
        "length": _when((n >= 50) & (n <= 50_000), n < 20),
        "word_size": _when(some & (c >= 3 * n) & (c <= 9 * n), some & ((c < 2 * n) | (c > 15 * n))),
        "symbols_by_words": _when(some & (F.col("n_symbols") * 50 <= n), some & (F.col("n_symbols") * 10 > n)),
        "symbols_by_chars": _when(some & (F.col("n_symbols") * 300 <= c), some & (F.col("n_symbols") * 50 > c)),
        "symbol_runs": _when(some & (F.col("n_symbol_runs") == 0), some & (F.col("n_symbol_runs") * 20 > n)),
        "symbol_lines": _when((lines >= 1) & (F.col("n_symbol_lines") * 10 <= lines), (lines >= 1) & (F.col("n_symbol_lines") * 2 > lines)),
        "line_copies": _when((lines >= 2) & (F.col("n_dup_lines") == 0), (lines >= 3) & (F.col("n_dup_lines") * 3 > lines)),
        "repeats": _when(some & (F.col("n_repeat_words") * 20 <= n), some & (F.col("n_repeat_words") * 10 > n * 3)),
        "variety": _when(some & (F.col("n_kinds") * 5 >= n * 2), some & (n <= 2000) & (F.col("n_kinds") * 5 < n)),
        "endings": _when((lines >= 1) & (F.col("n_ended") * 2 >= lines), (lines >= 4) & (F.col("n_ended") * 10 < lines)),
    }


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` (without columns named like those of ``INNER``) with the numbers that the rules see (long): ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, and those of ``MORE``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = df.withColumn("_text", text).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))

    # The hash of each 3-word window carries its place in its low bits, as many as the text needs.
    # Sorting brings equal windows together; neighbours are held against each other word by word, since a long
    # text leaves few bits to the hash; the words of repeated windows are counted along the places.
    n = F.size("_words")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    hashes = F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.bitwise_not(mask).bitwiseAND(window(i)).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_h", F.sort_array(hashes)).withColumn("_mask", mask)
    mask = F.col("_mask")
    word = lambda x, k: F.get("_words", x.bitwiseAND(mask).cast("int") + k)
    equal = lambda x, y: (F.bitwise_not(mask).bitwiseAND(x.bitwiseXOR(y)) == 0) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
    beside = lambda x, j: F.coalesce(equal(x, F.get("_h", j)), F.lit(False))
    hit = F.filter("_h", lambda x, j: beside(x, j + 1) | ((j > 0) & beside(x, F.greatest(j - 1, F.lit(0)))))
    df = df.withColumn("_hits", F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(mask))))
    steps = F.transform("_hits", lambda x, j: F.when(j == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), x - F.get("_hits", F.greatest(j - 1, F.lit(0))))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0).cast("long"))
    whole = F.length("_text")
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (whole - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated,
        "n_lines": F.size("_lines").cast("long"),
        "n_ended": F.size(F.filter("_lines", lambda x: x.rlike(ENDS))).cast("long"),
        "n_kinds": F.size(F.array_distinct("_words")).cast("long"),
        "n_symbol_runs": F.regexp_count("_text", F.lit(f"[{SYMBOLS}]{{2,}}")).cast("long"),
        "n_symbol_lines": F.size(F.filter("_lines", lambda x: x.rlike(f"[{SYMBOLS}]"))).cast("long"),
    })
    return df.drop("_text", "_words", "_lines", "_h", "_mask", "_hits")


class Model:
    """The share of good texts and, for each rule, the probability of each vote given good and given bad."""

    def __init__(self, good: float, votes: dict[str, dict[int, tuple[float, float]]]):
        self.good, self.votes = good, votes

    def posterior(self) -> Column:
        """The probability of good, from columns ``_vote_<rule>``."""
        total = F.lit(math.log(self.good / (1 - self.good)))
        for name, of in self.votes.items():
            ratio = {v: math.log(a / b) for v, (a, b) in of.items()}
            vote = F.col(f"_vote_{name}")
            total = total + F.when(vote == 1, ratio[1]).when(vote == -1, ratio[-1]).otherwise(ratio[0])
        return F.round(1 / (1 + F.exp(-total)), 9)


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200) -> Model:
    """Expectation-maximisation over (votes, number of texts).

    It starts from the belief that rules seldom vote bad on a good text: 0.95
    without such a vote, 0.6 with one, 0.05 with more. An estimate is smoothed by
    one text for each vote. Without texts every vote counts for nothing.
    """
    whole = sum(n for _, n in patterns)
    belief = [(0.95, 0.6, 0.05)[min(2, votes.count(-1))] for votes, _ in patterns]
    good, table = 0.5, {name: {v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for name in names}
    for _ in range(rounds if whole else 0):
        there = sum(p * n for p, (_, n) in zip(belief, patterns, strict=True))
        before, good = good, min(max((there + 1) / (whole + 2), 1e-6), 1 - 1e-6)
        for k, name in enumerate(names):
            mass = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for p, (votes, n) in zip(belief, patterns, strict=True):
                mass[votes[k]][0] += p * n
                mass[votes[k]][1] += (1 - p) * n
            sums = [sum(m[side] for m in mass.values()) for side in (0, 1)]
            table[name] = {v: (m[0] / sums[0], m[1] / sums[1]) for v, m in mass.items()}
        belief = []
        for votes, _ in patterns:
            odds = math.log(good / (1 - good)) + sum(math.log(table[name][v][0] / table[name][v][1]) for name, v in zip(names, votes, strict=True))
            belief.append(1 / (1 + math.exp(-min(max(odds, -500), 500))))
        if abs(good - before) < 1e-10:
            break
    return Model(good, table)


def judged(df: DataFrame, text_col: str = "text", least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """``df`` (of its columns those in ``carry``, or all) with its measures, ``posterior``, ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated
    3-word windows. ``kept``: not ``base_failed``, and a posterior of ``least`` or
    more. Defined results: null and empty texts have no words and fail; rows are
    judged each by its own text; columns of the names of the results are
    replaced (in any case), others pass through whatever their names; texts of any
    length are measured whole. An empty table gives an empty one.
    """
    votes = rules()
    kept = [c for c in df.columns if c.lower() not in (*BASE, *MORE, "posterior", "base_failed", "kept")]
    df, renamed = set_aside(df.select(*(F.col(f"`{c}`") for c in kept)), (*INNER, *(f"_vote_{name}" for name in votes)))
    text_col = renamed.get(text_col, text_col)
    voted = measures(df, text_col).withColumns({f"_vote_{name}": vote for name, vote in votes.items()})
    if carry is not None:
        voted = voted.drop(*(renamed.get(c, c) for c in kept if c not in carry))
    # measured once: both the fit and the result read this table
    voted = Workspace(df.sparkSession, "quality").write(voted)
    columns = [f"_vote_{name}" for name in votes]
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    # fitted on all rows, also those that fail the base; at most 3 ** len(rules()) rows reach the driver
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*columns).count().collect()]
    model = fit(sorted(patterns), list(votes))
    out = voted.withColumn("posterior", model.posterior()).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop(*columns)
    return out.withColumnsRenamed({name: c for c, name in renamed.items()})
