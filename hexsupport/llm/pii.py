"""Personal data: base patterns, and further spans chosen by boosted trees, in built-in functions only.

Generators with high recall propose spans, which may overlap: every part of a
number run that begins and ends with a group of digits, as phone and as card
number, and spelled-out addresses. Format and context features of each go
through gradient-boosted trees, which are compiled into column expressions; a
span is chosen above its kind's threshold, calibrated on held-out examples. The trees are trained on the driver on at most
``EXAMPLES`` labelled examples that ``examples`` writes, with the same features.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexsupport.llm.store import set_aside

KINDS = ("email", "ip", "card", "phone")
#: Same matches as the plain patterns, but in linear time and without deep recursion on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this (a number of digits, a character) has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
GENERATORS = {
    "spelled": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?: ?[(\[]at[)\]] ?| at )[a-z0-9-]{1,63}(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[a-z0-9-]{1,63}){1,4}+(?![a-z0-9])",
    "number": r"[(]?+[0-9](?:[().\x20/-]*+[0-9]){6,}+",
}
#: Characters of a proposed number at most, and its digits.
LONGEST, DIGITS = 43, (7, 19)
_OPEN, _CLOSE = "﷐", "﷑"
#: Context words, by what they speak for.
CONTEXT = {
    "to_call": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|dial|text me|whatsapp|handy|telefon|téléphone|teléfono|móvil|portable)\b",
    "to_pay": r"(?i)\b(?:card|visa|amex|mastercard|credit|debit|cc|carte|karte|tarjeta)\b",
    "to_write": r"(?i)\b(?:mail|e-mail|email|contact|write|reach|address|courriel|correo)\b",
    "to_count": r"(?i)(?:\b(?:order|invoice|id|version|isbn|page|pages|ticket|ref|sku|price|date|serial|line|item|section|chapter|room|total|model)\b|[$€£#])",
}
#: Labelled examples that the trees are trained on.
EXAMPLES = 3000
ROUNDS, SHRINK, BINS = 40, 0.3, 16
#: Least precision on held-out examples at a kind's threshold.
PRECISION = 0.98

#: Characters of a text in which spans are proposed at once, and those seen on both sides of them; matches that are placed at once.
SEGMENT, MARGIN, BLOCK = 8192, 512, 64
INNER = ("_text", *(f"_{kind}" for kind in KINDS))

_SPAN = "array<struct<s:int,e:int,m:string>>"
_RANKED = "array<struct<rank:int,kind:string,s:int,e:int>>"


def _let(value: Column, f) -> Column:
    """``f(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def found(text: Column, pattern: str, likely: Column) -> Column:
    """The matches of a pattern in a text, as (s, e, m): code points from ``s`` up to ``e``; placed block by block, so that the time is linear."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        own = F.array(F.struct(acc["at"].alias("s"), end.alias("e"), x.alias("m")))
        return F.struct((acc["i"] + 1).alias("i"), end.alias("at"), F.when(acc["i"] % 2 == 1, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda total, x: total + F.length(x)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        offsets = F.aggregate(sizes, start, add, lambda acc: acc["out"])
        first = lambda at: F.struct(F.lit(0).alias("i"), at.alias("at"), none.alias("out"))
        return _let(offsets, lambda at: F.flatten(F.transform(blocks, lambda block, k: F.aggregate(block, first(F.get(at, k)), step, lambda acc: acc["out"]))))

    blocks = _let(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(2 * BLOCK)), lambda i: F.slice(p, i, F.lit(2 * BLOCK))))
    return F.when(likely, _let(blocks, placed)).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    places = F.sequence(F.lit(1), F.length(number))
    value = lambda i: F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    return F.aggregate(F.transform(places, part), F.lit(0), lambda total, x: total + x) % 10 == 0


def _fits(kind: str, m: Column) -> Column:
    """What a match of a base pattern must fulfil."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(bare(x)) <= 3) & (F.concat(F.lit("0"), F.substr(bare(x), F.lit(1), F.lit(3))).cast("int") <= 255))
    n = F.length(digits(m))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(digits(m))).otherwise(False)
    return (n >= 8) & (n <= 15)


def _fitting(kind: str):
    return lambda x: _fits(kind, x["m"])


def _ranked(kind: str):
    return lambda x: F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def number_of(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def with_base(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``_text`` and the base spans ``_email``, ``_ip``, ``_card``, ``_phone``."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), _OPEN + _CLOSE, "��")
    df = df.withColumn("_text", text)
    for kind in KINDS:
        likely = F.contains("_text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("_text").rlike("[0-9][ -]?[0-9]")
        if kind == "ip":
            likely = F.col("_text").rlike(r"[0-9]\.[0-9]")
        df = df.withColumn(f"_{kind}", F.filter(found(F.col("_text"), BASE[kind], likely), _fitting(kind)))
    return df


FEATURES = (
    "card", "email", "digits", "length", "spaces", "dashes", "dots", "parens", "slashes", "luhn", "groups", "first_group", "last_group", "dated", "marked",
    *CONTEXT, "unit_after", "joined_before", "joined_after",
)


def _features(kind: str, m: Column, before: Column, after: Column) -> Column:
    n = F.length(m)
    count = lambda chars: n - F.length(F.translate(m, chars, ""))
    number = digits(m)
    parts = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    values = {
        "card": F.lit(int(kind == "card")), "email": F.lit(int(kind == "email")), "digits": F.length(number), "length": n, "spaces": count(" "), "dashes": count("-"), "dots": count("."),
        "parens": count("()"), "slashes": count("/"), "luhn": F.when((F.length(number) >= 12) & luhn(number), 1).otherwise(0), "groups": F.size(parts),
        "first_group": F.coalesce(F.length(F.get(parts, F.lit(0))), F.lit(0)), "last_group": F.coalesce(F.length(F.get(parts, F.size(parts) - 1)), F.lit(0)),
        "dated": m.rlike(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}").cast("int"), "marked": m.rlike(r"(?i)[(\[](?:at|dot)[)\]]").cast("int"),
        **{name: before.rlike(pattern).cast("int") for name, pattern in CONTEXT.items()}, "unit_after": after.rlike(r"^\s?(?:%|usd|eur|kg|km|px|ms|€|\$|x\b)").cast("int"),
        # 1: digits beside it, 2: digits joined to it, 3: a word joined to it
        "joined_before": F.when(before.rlike(r"[0-9][-./,:]$"), 2).when(before.rlike(r"[0-9][().\x20/-]{1,3}$"), 1).when(before.rlike(r"[A-Za-z][-./,:_]$"), 3).otherwise(0),
        "joined_after": F.when(after.rlike(r"^[-./,:][0-9]"), 2).when(after.rlike(r"^[().\x20/-]{1,3}[0-9]"), 1).when(after.rlike(r"^[-./,:_][A-Za-z]"), 3).otherwise(0),
    }
    return F.struct(*(values[name].cast("int").alias(name) for name in FEATURES))


_CANDIDATE = f"array<struct<kind:string,s:int,e:int,f:struct<{','.join(f'{n}:int' for n in FEATURES)}>>>"


def _parts(text: Column, run: Column) -> Column:
    """The parts of a number run that begin and end with a whole group of digits and have ``DIGITS``, as (s, e, m)."""
    before, after = F.substr(text, F.greatest(run["s"], F.lit(1)), F.least(run["s"], F.lit(1))), F.substr(text, run["e"] + 1, F.lit(1))

    def of(chars: Column) -> Column:
        n = F.length(run["m"])
        digit = lambda i: F.coalesce(F.get(chars, i).between("0", "9"), F.lit(False))
        # a group that goes on in letters, or follows a plus sign, is not whole
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: digit(i) & ~digit(i - 1))
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: digit(i - 1) & ~digit(i))
        return _let(F.struct(starts.alias("starts"), ends.alias("ends"), before.rlike("[A-Za-z0-9+]").alias("torn_before"), after.rlike("[A-Za-z0-9]").alias("torn_after"), n.alias("n")), lambda g: pairs(chars, g))

    def pairs(chars: Column, g: Column) -> Column:
        # each group has a digit at least
        later = lambda k: F.sequence(k, F.least(k + DIGITS[1] - 1, F.size(g["ends"]) - 1))
        first = lambda a: F.when(F.coalesce(F.get(chars, a - 1) == "(", F.lit(False)), a - 1).otherwise(a)
        both = F.flatten(F.transform(g["starts"], lambda a, k: F.transform(later(k), lambda j: F.struct(first(a).alias("a"), F.get(g["ends"], j).alias("b")))))
        both = F.filter(both, lambda x: (x["b"] - x["a"] <= LONGEST) & ((x["a"] > 0) | ~g["torn_before"]) & ((x["b"] < g["n"]) | ~g["torn_after"]))
        return F.transform(both, lambda x: F.struct((run["s"] + x["a"]).alias("s"), (run["s"] + x["b"]).alias("e"), F.substr(run["m"], x["a"] + 1, x["b"] - x["a"]).alias("m")))

    return F.filter(_let(F.split(run["m"], ""), of), lambda x: F.length(digits(x["m"])).between(*DIGITS))


def candidates(text: Column) -> Column:
    """Every proposed span of every kind in a text, with its features."""
    digit = text.rlike("[0-9]")
    spelled = found(text, GENERATORS["spelled"], text.rlike(r"(?i)[(\[ ]at[)\] ]") & (text.rlike(r"(?i)[(\[ ]dot[)\] ]| at [a-z0-9-]++\.")))
    numbers = F.flatten(F.transform(found(text, GENERATORS["number"], digit), lambda run: _parts(text, run))).cast(_SPAN)

    def proposed(x: Column, kind: str) -> Column:
        before = F.substr(text, F.greatest(x["s"] - 29, F.lit(1)), F.least(x["s"], F.lit(30)))
        after = F.substr(text, x["e"] + 1, F.lit(6))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _features(kind, x["m"], before, after).alias("f"))

    def each(g: Column) -> Column:
        size = lambda x: F.length(digits(x["m"]))
        kinds = [
            F.transform(g["spelled"], lambda x: proposed(x, "email")),
            F.transform(F.filter(g["numbers"], lambda x: (size(x) >= 13) & (size(x) <= 19)), lambda x: proposed(x, "card")),
            F.transform(F.filter(g["numbers"], lambda x: (size(x) >= 7) & (size(x) <= 15)), lambda x: proposed(x, "phone")),
        ]
        return F.concat(*(k.cast(_CANDIDATE) for k in kinds))

    return _let(F.struct(spelled.alias("spelled"), numbers.alias("numbers")), each)


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts: (text, the places of its personal spans)."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioulrstnmdcp") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("3456") + d(rng.choice((12, 14, 13)))
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in body[::-1]))
        whole = body + str(-total % 10)
        return whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    phone = lambda: rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"0{d(3)}/{d(7)}", f"{d(3)}.{d(3)}.{d(4)}"))
    mail = lambda: f"{word()}{rng.choice((' at ', ' (at) ', '[at]', '(at)'))}{word()}{rng.choice((' dot ', ' (dot) ', '[dot]', '.'))}{rng.choice(('com', 'org', 'net', 'de'))}"
    date = lambda: rng.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/19{d(2)}", f"20{d(2)}{d(4)}"))
    plain = lambda: rng.choice((d(rng.randint(7, 12)), d(rng.randint(13, 19)), f"{d(1)}.{d(3)}.{d(3)}.{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(5)}-{d(3)}-{d(1)}", f"{d(4)} {d(4)} {d(4)} {d(3)}", f"{d(3)} - {d(4)}"))
    prose = lambda: f"{word()} at {word()}{rng.choice(('.', ' dot '))}{word()}"
    call, pay, write = ("call ", "tel: ", "phone ", "fax: ", "mobile: ", "dial "), ("card ", "visa ", "credit card: ", "amex "), ("mail ", "contact ", "write to ", "reach me: ")
    count = ("order ", "invoice ", "id ", "version ", "isbn ", "pages ", "ref ", "total $", "serial ", "date ", "model ")
    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    beside, joint = (" ", " ", " / ", ", ", "; ", " - "), (".", ",", "-", ":")
    out = []
    for _ in range(n):
        kind = rng.randrange(18)
        lead = " ".join(word() for _ in range(rng.randint(0, 4))) + " "
        parts = (
            [rng.choice(call), (phone(),)], [rng.choice(pay), (card(),)], [rng.choice(write), (mail(),)], [(f"({d(3)}) {d(3)}-{d(4)}",)], [rng.choice(write), (mail(),)],
            [rng.choice(count), plain()], [plain()], [rng.choice(count), date()], [date()], [prose()], [plain(), rng.choice((" kg", "%", " ms", " eur"))],
            [rng.choice(call), (phone(),), *(x for _ in range(rng.randint(1, 4)) for x in (rng.choice(beside), (phone(),)))], [date(), " ", (phone(),)], [rng.choice(("", *call)), (f"({d(3)}) {d(3)}-{d(4)}",), " ", ip()],
            [rng.choice(call).rstrip(": "), rng.choice(joint), (phone(),)], [word(), rng.choice(joint), plain()], [rng.choice(pay), (card(),), rng.choice(beside), (phone(),)], [plain(), " ", plain()],
        )[kind]
        text, spans = lead, []
        for part in parts:
            own = part if isinstance(part, str) else part[0]
            if own is not part:
                spans.append((len(text), len(text) + len(own)))
            text += own
        out.append((f"{text}{'' if kind == 10 else ' ' + word()}", spans))
    return out


class Trees:
    """Boosted trees of two levels: (feature, cut, (feature, cut, low, high), (feature, cut, low, high))."""

    def __init__(self, base: float, trees: list, least: dict[str, float]):
        self.base, self.trees, self.least = base, trees, least

    def chance(self, f: Column) -> Column:
        def leaf(node) -> Column:
            name, cut, low, high = node
            return F.when(f[name] <= cut, low).otherwise(high)

        total = reduce(lambda a, t: a + F.when(f[t[0]] <= t[1], leaf(t[2])).otherwise(leaf(t[3])), self.trees, F.lit(self.base))
        return 1 / (1 + F.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], rounds: int = ROUNDS) -> tuple[float, list]:
    """Newton boosting of the logistic loss with cuts at quantiles."""
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    cuts = [(k, float(c)) for k in range(x.shape[1]) for c in np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[:-1]).astype(int)) if (x[:, k] > c).any()]
    sides = np.array([x[:, k] <= c for k, c in cuts])
    score, trees = np.full(len(y), base), []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> int:
        low_g, low_h = sides @ (g * rows), sides @ (h * rows)
        high_g, high_h = (g * rows).sum() - low_g, (h * rows).sum() - low_h
        return int((low_g**2 / (low_h + 1) + high_g**2 / (high_h + 1)).argmax())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        top = best(np.ones(len(y)), g, h)
        kids = []
        for rows in (sides[top], ~sides[top]):
            at = best(rows, g, h)
            ends = []
            for own in (rows & sides[at], rows & ~sides[at]):
                step = SHRINK * float((g * own).sum() / ((h * own).sum() + 1))
                score = score + step * own
                ends.append(round(step, 9))
            kids.append((names[cuts[at][0]], cuts[at][1], *ends))
        trees.append((names[cuts[top][0]], cuts[top][1], *kids))
    return base, trees


def train(spark: SparkSession, n: int = EXAMPLES, precision: float = PRECISION) -> Trees:
    """Trees of ``n`` examples: three quarters train them, the rest calibrates each kind's threshold."""
    written = examples(n)
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(written)], "i int, text string")
    rows = rows.select("i", F.explode(candidates(F.col("text"))).alias("c")).select("i", "c.kind", "c.s", "c.e", "c.f.*").collect()
    rows = sorted(rows, key=lambda r: (r.i, r.kind, r.s, r.e))
    x = np.array([[r[name] for name in FEATURES] for r in rows], np.int64)

    def good(r) -> bool:
        # an address that meets a personal span; a number that is just that span, as the kind that its digits allow
        if r.kind == "email":
            return any(a < r.e and r.s < b for a, b in written[r.i][1])
        return (r.s, r.e) in written[r.i][1] and (r.kind == "card") == (r.luhn == 1 and r.digits >= 13)

    y = np.array([float(good(r)) for r in rows])
    held = np.array([r.i % 4 == 0 for r in rows])
    base, trees = boost(x[~held], y[~held], FEATURES)
    score = np.full(len(y), base)
    column = {name: x[:, k] for k, name in enumerate(FEATURES)}
    for name, cut, low, high in trees:
        ends = [np.where(column[a] <= b, c, d) for a, b, c, d in (low, high)]
        score += np.where(column[name] <= cut, *ends)
    chance, least = 1 / (1 + np.exp(-score)), {}
    for kind in KINDS:
        own = held & np.array([r.kind == kind for r in rows])
        steps = sorted(set(np.round(chance[own & (y == 1)], 6).tolist()))
        least[kind] = next((t for t in steps if t >= 0.5 and y[own & (chance >= t - 1e-6)].mean() >= precision), 1.1)
    return Trees(base, trees, {k: min(1.1, v - 1e-6) for k, v in least.items()})


def _added(trees: Trees) -> Column:
    """The chosen spans beside ``base`` of ``_text``, segment by segment."""
    bound = lambda kind: reduce(lambda a, k: F.when(kind == k, trees.least[k]).otherwise(a), KINDS, F.lit(1.1))
    rank = lambda kind: reduce(lambda a, k: F.when(kind == k, KINDS.index(k)).otherwise(a), KINDS, F.lit(len(KINDS)))
    overlap = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])
    text = F.col("_text")

    def segment(a: Column) -> Column:
        low = F.greatest(a - MARGIN, F.lit(0))
        return F.struct(a.alias("core"), low.alias("low"), F.substr(text, low + 1, a - low + SEGMENT + MARGIN).alias("text"))

    def chosen(g: Column) -> Column:
        def score(near: Column) -> Column:
            scored = F.transform(candidates(g["text"]), lambda c: F.struct((-trees.chance(c["f"])).alias("p"), (c["s"] - c["e"]).alias("size"), c["kind"].alias("kind"), (c["s"] + g["low"]).alias("s"), (c["e"] + g["low"]).alias("e")))
            return F.array_sort(F.filter(scored, lambda c: (-c["p"] >= bound(c["kind"])) & ~F.exists(near, lambda b: overlap(b, c))))

        near = F.filter("base", lambda b: (b["e"] > g["low"]) & (b["s"] < g["low"] + F.length(g["text"])))
        one = lambda c: F.array(F.struct(rank(c["kind"]).alias("rank"), c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
        kept = F.aggregate(_let(near, score), F.array().cast(_RANKED), lambda out, c: F.when(F.exists(out, lambda o: overlap(o, c)), out).otherwise(F.concat(out, one(c)).cast(_RANKED)))
        return F.filter(kept, lambda c: (c["s"] >= g["core"]) & (c["s"] < g["core"] + SEGMENT))

    segments = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(SEGMENT)), segment)
    return F.flatten(F.transform(segments, chosen))


def detected(df: DataFrame, text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (rank, kind, s, e), base matches and all chosen spans.

    ``rank`` is the kind's place in ``KINDS``; both are sorted by rank, then start.
    Base matches always stay; a proposed span is chosen where its probability
    reaches its kind's threshold and it overlaps no base match and no better
    chosen one (of equal ones the longer is better). Defined results: null and
    empty texts have no spans; rows, repeated or not, are judged each by its own
    text; texts of any length are searched whole, in segments that see
    ``MARGIN`` characters on both sides, so the time grows with the length;
    columns named ``base`` or ``spans`` (in any case) are replaced, others pass
    through whatever their names. An empty table gives an empty one.
    """
    trees = trees or train(df.sparkSession)
    rest = [c for c in df.columns if c.lower() not in ("base", "spans")]
    df, renamed = set_aside(df.select(*(F.col(f"`{c}`") for c in rest)), INNER)
    df = with_base(df, renamed.get(text_col, text_col))
    base = F.concat(*(F.transform(f"_{kind}", _ranked(kind)) for kind in KINDS))
    df = df.withColumn("base", F.array_sort(base))
    df = df.withColumn("spans", F.array_sort(F.concat("base", _added(trees))))
    return df.drop(*INNER).withColumnsRenamed({name: c for c, name in renamed.items()})


def listed(spans: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(df: DataFrame, text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """``df`` with each span of ``text_col`` replaced by its kind in brackets; of overlapping spans the first is named.

    Null and empty texts stay as they are; texts of any length are redacted
    whole; all columns pass through, whatever their names. An empty table gives
    an empty one.
    """
    own, renamed = set_aside(df, ("base", "spans"))
    own_text = renamed.get(text_col, text_col)
    marked = detected(own, own_text, trees)
    by_place = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    text = F.col(f"`{own_text}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    out = F.aggregate(by_place, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    marked = marked.withColumn(own_text, F.when(text.isNull(), text).otherwise(out))
    return marked.select(*(F.col(f"`{renamed.get(c, c)}`").alias(c) for c in df.columns))
