"""Personal data by generated candidates, boosted trees and calibrated thresholds.

For each kind (email, ip, card, phone) a strict and a loose pattern propose spans, which
may overlap.  Strict spans that pass their check (parts of an address, Luhn sum, number
of digits) are always taken.  The other candidates are labelled by their own evidence: their
value passes the check of its kind once separators, prefixes and words for signs are put
right, and its form, the words before it or a taken span that it touches tell the kind;
candidates without evidence either way have no label.  Boosted trees over format and context
features learn the labels, and a loose or failed span is added where its score exceeds a
threshold that kept the asked precision on labelled candidates the trees had not seen.
An added span never overlaps a strict one; of overlapping added ones the first, then
the longest stays.

Everything on the rows is DataFrame expressions; the driver sees counts of binned
feature vectors of a bounded sample.  Null text counts as empty; rows without a span
stay, with zero counts.  Rows with equal ids are documents of their own.  Without
candidates nothing is learned and nothing added.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.llm.common import store

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # labelled candidates that the trees are fitted on, as many of each kind, by the order of a hash
ROUNDS = 30
RATE = 0.3
PRECISION = 0.98
LEAST_SUPPORT = 20  # calibration candidates above a threshold that make it count
STEPS = 1000  # scores are counted in steps of a thousandth

# A match starts where the one before ended or where a run of its characters begins, which
# is where the plain pattern would start too; possessive runs never need to give back.
_NAME = r"A-Za-z0-9._%+\-"
_DOMAIN = r"[A-Za-z0-9\-]++"
STRICT = {
    "email": rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@{_DOMAIN}(?:\.{_DOMAIN})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
_AT = r"\x20?(?:@|[\[({]\x20?at\x20?[\])}])\x20?"
_DOT = r"(?:\.|\x20\.\x20|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)"  # a space after a plain dot alone ends a sentence
LOOSE = {
    "email": rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++{_AT}{_DOMAIN}(?:{_DOT}{_DOMAIN}){{1,8}}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/\-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][./\-])(?:00[1-9][0-9]{0,2}|\(?[0-9]{2,4}\)?)[\x20./\-]\x20?[0-9]{3,4}[\x20./\-][0-9]{3,4}(?![\x20./\-]?[0-9])",
}
# what a text must hold for a pattern to be worth trying
_NEEDS = {"email": "@|[\\[({]\\x20?at\\x20?[\\])}]", "ip": "[0-9]\\.[0-9]|[0-9A-Fa-f]:", "card": "[0-9]", "phone": "[0-9]"}
_WORDS = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto)\W*$", "ip": r"(?i)(?:\bip|address|host|server)\W*$",
    "card": r"(?i)(?:card|visa|credit|account|pay)\W*$", "phone": r"(?i)(?:phone|tel|call|mobile|fax)\W*$",
}


def _describe(kind: str, strict: bool):
    def of(pair: Column, nth: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), nth.alias("nth"),
            F.length(pair["gap"]).alias("gap"), F.right(pair["gap"], F.lit(24)).alias("before"),
            F.left(pair["gap"], F.lit(2)).alias("head"), pair["value"].alias("value"))

    return of


def candidates(docs: DataFrame) -> DataFrame:
    """Rows ``row, doc_id, kind, strict, start, end, value, before, after`` for each proposed span.

    Positions count code points, ``end`` exclusive.  A document without any has one row
    with a null kind.
    """
    text = F.coalesce("text", F.lit(""))
    found = []
    for strict, patterns in ((True, STRICT), (False, LOOSE)):
        for kind, pattern in patterns.items():
            # what is matched and what lies before each match and after the last
            pairs = F.arrays_zip(
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
                F.split(text, pattern, -1).alias("gap"))
            spans = F.transform(pairs, _describe(kind, strict))
            found.append(F.when(text.rlike(_NEEDS[kind]) & text.rlike(pattern), spans))
    none = F.array().cast(
        "array<struct<kind:string,strict:boolean,nth:int,gap:int,before:string,head:string,value:string>>")
    every = F.flatten(F.array(*[F.coalesce(x, none) for x in found]))
    rows = docs.select("doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", every.alias("found"))
    in_turn = Window.partitionBy("row", "kind", "strict").orderBy("nth")
    so_far = in_turn.rowsBetween(Window.unboundedPreceding, 0)
    spread = rows.select("row", "doc_id", F.explode_outer("found").alias("x")).select("row", "doc_id", "x.*")
    return (
        spread.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(so_far))
        .withColumn("start", F.col("end") - F.length("value"))
        .withColumn("after", F.lead("head").over(in_turn))
        .filter("kind is null or value is not null")
        .drop("nth", "gap", "head"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: Column, value: Column) -> Column:
    """The check of a strict span: parts at most 255, Luhn sum, number of digits."""
    digits = _digits(value)
    back = F.reverse(digits)
    turned = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    luhn = F.aggregate(turned, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0
    small = F.forall(F.split(value, "\\."), lambda part: (
        F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(13, 19), luhn).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15)))


def valid(kind: Column, strict: Column, value: Column) -> Column:
    """Whether a value passes the check of its kind once words for signs, spaces and prefixes are put right."""
    address = F.regexp_replace(F.regexp_replace(value, _AT, "@"), _DOT, ".")
    groups, halves = F.split(value, ":", -1), F.split(value, "::", -1)
    # eight groups, or fewer around one double colon
    short = (F.size(halves) == 2) & ~F.exists(halves, lambda x: x.startswith(":") | x.endswith(":")) & (F.size(groups) <= 8)
    number = F.regexp_replace(value, "^00", "")
    return F.when(strict | (kind == "card"), passes(kind, value)).otherwise(
        F.when(kind == "email", address.rlike(rf"^[{_NAME}]+@{_DOMAIN}(?:\.{_DOMAIN})*\.[A-Za-z]{{2,}}$"))
        .when(kind == "ip", short | ((F.size(groups) == 8) & ~F.array_contains(groups, "")))
        .when(kind == "phone", passes(kind, number)))


def label(own_taken: Column, other_taken: Column) -> Column:
    """Whether a candidate is what its kind says, by its own evidence; null without evidence.

    Takes whether it shares characters with a taken span of its kind, and of another.
    """
    kind, value, context = F.col("kind"), F.col("value"), F.col("context")
    form = (
        F.when(kind == "email", value.rlike("[\\[({]") | ~value.contains(" "))
        .when(kind == "phone", value.startswith("00") | value.startswith("("))
        .otherwise(True))
    return (
        F.when(kind.isNull(), F.lit(None).cast("boolean"))
        .when(F.col("valid") == 0, False).when(own_taken, True).when(other_taken, False)
        .when(context == 2, True).when(form, True).when(context == 1, False))


def features() -> dict[str, Column]:
    """Binned format and context features of a candidate, as small whole numbers."""
    value, before = F.col("value"), F.col("before")
    last, following = F.right(before, F.lit(1)), F.left("after", F.lit(1))

    def edge(c: Column) -> Column:
        return (F.when(c == "", 0).when(c.rlike("\\s"), 1).when(c.rlike("[\\p{L}_]"), 2)
                .when(c.rlike("[0-9]"), 3).otherwise(4))

    own = F.lit(0)
    for kind, words in _WORDS.items():
        own = F.when(before.rlike(words), F.when(F.col("kind") == kind, 2).otherwise(1)).otherwise(own)
    digits = F.length(_digits(value))
    separators = F.regexp_replace(value, "[A-Za-z0-9]", "")
    return {
        "of_kind": F.element_at(F.create_map(*[
            F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind")),
        "digits": F.least(digits, F.lit(24)),
        "length": F.least(F.floor(F.length(value) / 4), F.lit(15)).cast("int"),
        "letters": F.least(F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.lit(8)),
        "separators": F.least(F.length(separators), F.lit(8)),
        "different": F.least(F.size(F.array_distinct(F.split(separators, ""))), F.lit(5)),
        "spaces": F.least(F.length(F.regexp_replace(value, "[^ ]", "")), F.lit(5)),
        "brackets": F.when(value.rlike("[\\[({]"), 1).otherwise(0),
        "plus": F.when(value.startswith("+"), 1).otherwise(0),
        "zero": F.when(value.startswith("0"), 1).otherwise(0),
        "variety": F.least(F.size(F.array_distinct(F.split(_digits(value), ""))), F.lit(9)),
        "widest": F.when(value.rlike("[0-9]{7}"), 2).when(value.rlike("[0-9]{4}"), 1).otherwise(0),
        "left": edge(last), "right": edge(following), "context": own,
        "valid": F.coalesce(valid(F.col("kind"), F.col("strict"), value), F.lit(False)).cast("int"),
    }


@dataclass
class Model:
    """A start score, trees as ``(feature, cut, left, right)`` or leaf values, thresholds by kind."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def column(self) -> Column:
        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, low, high = node
            return F.when(F.col(name) <= cut, of(low)).otherwise(of(high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + of(tree)
        return total


def _leaf(slope: np.ndarray, bend: np.ndarray) -> float:
    return float(-RATE * slope.sum() / (bend.sum() + 1.0))


def _split(names, x, slope, bend):
    """The feature and cut with the largest gain, or None."""
    best, found = 1e-6, None
    parent = slope.sum() ** 2 / (bend.sum() + 1.0)
    for column, name in enumerate(names):
        for cut in np.unique(x[:, column])[:-1]:
            low = x[:, column] <= cut
            gain = (slope[low].sum() ** 2 / (bend[low].sum() + 1.0)
                    + slope[~low].sum() ** 2 / (bend[~low].sum() + 1.0) - parent)
            if gain > best:
                best, found = gain, (name, int(cut), low)
    return found


def _tree(names, x, slope, bend, depth: int):
    found = _split(names, x, slope, bend) if depth else None
    if found is None:
        return _leaf(slope, bend)
    name, cut, low = found
    return (name, cut, _tree(names, x[low], slope[low], bend[low], depth - 1),
            _tree(names, x[~low], slope[~low], bend[~low], depth - 1))


def _value(tree, names, row) -> float:
    while not isinstance(tree, float):
        name, cut, low, high = tree
        tree = low if row[names.index(name)] <= cut else high
    return tree


def fit(featured: DataFrame, most: int = SAMPLE) -> Model:
    """Gradient boosting on candidates with feature columns and ``good``, what they are to predict (null
    without a label), and ``order``, a hash.

    Four fifths grow the trees, as a sample of each kind; all of the rest set each kind's threshold.
    """
    names = list(features())
    labelled = featured.filter("good is not null")
    aside = F.pmod("order", F.lit(5)) == 0
    parts = [
        labelled.filter(~aside & (F.col("kind") == kind)).orderBy("order").limit(max(1, most // len(KINDS))) for kind in KINDS]
    told = (F.sum(F.col("good").cast("long")).alias("good"), F.count(F.lit(1)).alias("n"))
    counted = reduce(DataFrame.union, parts).groupBy(*names).agg(*told).orderBy(*names).collect()
    model = Model()
    if not counted:
        return model
    x = np.array([[r[n] for n in names] for r in counted])
    good, n = (np.array([r[i] for r in counted], dtype=float) for i in ("good", "n"))
    share = (good.sum() + 1) / (n.sum() + 2)
    model.start = float(np.log(share / (1 - share)))
    score = np.full(len(x), model.start)
    for _ in range(ROUNDS):
        chance = 1 / (1 + np.exp(-score))
        tree = _tree(names, x, n * chance - good, n * chance * (1 - chance), 3)
        model.trees.append(tree)
        score = score + np.array([_value(tree, names, row) for row in x])
    step = F.floor(model.column() * STEPS)
    scored = labelled.filter(aside).groupBy("kind", step.alias("step")).agg(*told).collect()
    for kind in KINDS:
        good = n = 0
        for r in sorted((r for r in scored if r["kind"] == kind), key=lambda r: -r["step"]):
            good, n = good + r["good"], n + r["n"]
            if n >= LEAST_SUPPORT and good / n >= PRECISION:
                model.thresholds[kind] = r["step"] / STEPS
    return model


def find(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Rows ``row, doc_id, spans`` for each row of ``docs`` (``doc_id, text``): all its spans as structs
    ``rank, start, end, base, kind``, sorted by kind as listed, then start."""
    proposed = store(candidates(docs), "candidates")
    featured = proposed.withColumns(features()).withColumn(
        "base", F.coalesce(F.col("strict") & passes(F.col("kind"), F.col("value")), F.lit(False)))

    def touches_taken(keys: tuple[str, ...]) -> Column:
        order = Window.partitionBy(*keys).orderBy("start")
        taken = lambda c: F.when(F.col("base"), F.col(c))
        return F.coalesce(
            (F.max(taken("end")).over(order.rangeBetween(Window.unboundedPreceding, 0)) > F.col("start"))
            | (F.min(taken("start")).over(order.rangeBetween(0, Window.unboundedFollowing)) < F.col("end")),
            F.lit(False))

    featured = featured.withColumns({"own_taken": touches_taken(("row", "kind")), "any_taken": touches_taken(("row",))})
    featured = store(featured.select(
        "row", "doc_id", "kind", "start", "end", "base", *features(),
        label(F.col("own_taken"), F.col("any_taken")).alias("good"),
        F.xxhash64("doc_id", "kind", "strict", "start", "value").alias("order")), "labelled")
    model = fit(featured, most)
    above = F.lit(False)
    if model.thresholds:
        featured = featured.withColumn("score", model.column())
        for kind, threshold in model.thresholds.items():
            above = above | ((F.col("kind") == kind) & (F.col("score") >= threshold))
    in_order = Window.partitionBy("row").orderBy("start", F.desc("base"), F.desc("end"), "of_kind")
    until_here = in_order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = in_order.rowsBetween(1, Window.unboundedFollowing)
    def last(end: Column) -> Column:
        return F.coalesce(F.max(end).over(until_here), F.lit(-1))

    ahead = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(from_here), F.col("end"))
    chosen = (
        featured
        .withColumn("added", F.coalesce(above, F.lit(False)) & ~F.col("base")
                    & (last(F.when(F.col("base"), F.col("end"))) <= F.col("start")) & (ahead >= F.col("end")))
        .withColumn("kept", F.col("base") | (F.col("added") & (
            last(F.when(F.col("added"), F.col("end"))) <= F.col("start")))))
    return chosen.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.when(
        F.col("kept"),
        F.struct(F.col("of_kind").alias("rank"), "start", "end", "base", "kind")))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping ones the first rules."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(ordered, state, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        s["end"].alias("at"),
        F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                 F.lit("["), s["kind"], F.lit("]")).alias("out"))))
    return F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))
