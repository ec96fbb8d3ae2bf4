"""Personal data by candidate gradient boosting, in DataFrame operations only.

Fixed patterns give the base spans. High-recall generators propose further, overlapping spans: loosely
written mail addresses and any run of six or more digits. Format and context features describe them;
candidates that meet a base span are the positive examples; how an at sign is spelled, like the plus
sign of a phone number, is no feature, so that other spellings are judged by form and context. The features take few values, so counts
per feature combination over all rows hold all that training needs: boosted trees of small depth and a
calibration of their scores by held-out documents are fitted to that small table on the driver, and
applied as one SQL expression. A candidate that meets no base span and whose calibrated probability
reaches ``threshold`` is added as kind ``mail`` or ``number``.

Spans are found by cutting the text at the matches: starts are running sums of the lengths of pieces
and matches, and which candidates meet base spans is told by counts of starts and ends in sorted order,
so the work on a text grows as n log n with its matches. Context is the up to 24 characters between a
candidate and the one before it. Patterns use possessive groups, so that long runs need no deep recursion.

Defined results: a null text is empty and has no spans; rows that repeat a doc_id each get a row; an
empty table gives an empty result; extra columns are ignored. Spans count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_spans, running_sums
from .common import cut

# The patterns of the kinds, in the kinds' order. They match what the plain patterns
# match: where those could only begin again inside a run that has failed, a look-behind skips it.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
# Generators of candidates, and words that stand before personal data.
MAIL_LIKE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?(?:@|\[at\]|\(at\))\x20?)[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++"
NUMBER_LIKE = r"(?<![0-9])[0-9](?:[\x20().\-/]{0,2}[0-9]){5,}+"
CONTEXT = r"mail|tel|phone|call|mobile|fax|card|visa|iban|ssn|addr|contact"
DOMAINS = r"\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
SPANS = "array<struct<start:int,end:int,s:string,before:string>>"
FEATURES = ("gen", "digits", "separators", "groups", "first", "last", "luhn", "quad", "context", "form")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn check."""
    d = F.reverse(digits(s))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substring(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def small_parts(s: Column) -> Column:
    """Whether all dot-separated numbers of ``s`` are at most 255."""
    return F.forall(F.split(s, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(s, r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)


def base_kinds(text: Column) -> dict[str, Column]:
    return {
        "email": F.when(text.contains("@"), match_spans(text, EMAIL)).otherwise(F.array().cast(SPANS)),
        "ip": F.filter(match_spans(text, IP), lambda m: small_parts(m["s"])),
        "card": F.filter(match_spans(text, CARD), lambda m: luhn(m["s"])),
        "phone": F.filter(match_spans(text, PHONE), lambda m: F.length(digits(m["s"])).between(8, 15)),
    }


def _level(x: Column, *bounds: int) -> Column:
    """How many of the bounds ``x`` exceeds."""
    return sum((F.when(x > b, 1).otherwise(0) for b in bounds), F.lit(0))


def described(found: Column, gen: int) -> Column:
    """Adds the features to an array of candidate spans."""

    def one(m):
        s, n = m["s"], F.length(digits(m["s"]))
        groups = F.filter(F.split(s, "[^0-9]+"), lambda g: F.length(g) > 0)
        marks = [F.when(s.contains(c), F.lit(w)).otherwise(0) for c, w in ((" ", 1), (".", 2), ("-", 4), ("(", 8), ("/", 16))]
        edge = lambda i: F.coalesce(F.length(F.try_element_at(groups, F.lit(i))), F.lit(0))
        form = F.rlike(F.lower(s), F.lit(DOMAINS)) if gen == 0 else F.lit(0)
        number = [
            _level(n, 7, 9, 11, 12, 15, 19), sum(marks, F.lit(0)), _level(F.size(groups), 1, 2, 3, 4, 5), _level(edge(1), 1, 2, 3, 4), _level(edge(-1), 1, 2, 3, 4),
            F.when(n.between(13, 19), luhn(s).cast("int")).otherwise(0), F.when((F.size(groups) == 4) & F.rlike(s, F.lit(r"^[0-9.]+$")), small_parts(s).cast("int")).otherwise(0),
        ]
        values = [F.lit(gen), *([F.lit(0)] * 7 if gen == 0 else number), F.rlike(F.lower(m["before"]), F.lit(CONTEXT)).cast("int"), form]
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), *[v.cast("int").alias(k) for k, v in zip(FEATURES, values, strict=True)])

    return F.transform(found, one)


def meets(found: Column, base: Column) -> Column:
    """For each of an array of spans, whether it overlaps any of another: more of those begin before its end than end by its start."""

    def counted(point: Column, of: Column) -> Column:
        """How many base points come before each span's point, in the spans' order."""
        events = F.array_sort(F.concat(point, of))
        both = F.transform(F.array(events), lambda v: F.zip_with(v, running_sums(F.transform(v, lambda x: (x["i"] < 0).cast("int"))), lambda x, n: F.struct(x["i"].alias("i"), n.alias("n"))))
        return F.array_sort(F.filter(F.element_at(both, 1), lambda x: x["i"] >= 0))

    event = lambda at, order, i: F.struct(at.alias("at"), F.lit(order).alias("o"), i.alias("i"))
    starts = counted(F.transform(found, lambda c, i: event(c["end"], 0, i)), F.transform(base, lambda b: event(b["start"], 1, F.lit(-1))))
    ends = counted(F.transform(found, lambda c, i: event(c["start"], 1, i)), F.transform(base, lambda b: event(b["end"], 0, F.lit(-1))))
    return F.when(F.size(base) == 0, F.array_repeat(F.lit(0), F.size(found))).otherwise(F.zip_with(starts, ends, lambda x, y: (x["n"] > y["n"]).cast("int")))


# Boosting over counted feature combinations: rows are (features, number, positives).


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _best_split(rows, grads, hess, members):
    g, h = sum(grads[i] for i in members), sum(hess[i] for i in members)
    best = (0.0, None)
    for k in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for i in members:
            s = by.setdefault(rows[i][0][k], [0.0, 0.0])
            s[0] += grads[i]
            s[1] += hess[i]
        left_g = left_h = 0.0
        for v in sorted(by)[:-1]:
            left_g, left_h = left_g + by[v][0], left_h + by[v][1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, (k, v))
    return best[1], -g / (h + 1)


def boost(rows: list[tuple[tuple[int, ...], int, int]], rounds: int = 40, rate: float = 0.3, depth: int = 3) -> list:
    """Trees as nested (feature, bound, left, right) or leaf values, for a sum of log odds."""
    score, trees = [0.0] * len(rows), []

    def grow(members, level):
        split, value = _best_split(rows, grads, hess, members)
        if split is None or level == 0:
            for i in members:
                score[i] += rate * value
            return rate * value
        k, v = split
        return (k, v, grow([i for i in members if rows[i][0][k] <= v], level - 1), grow([i for i in members if rows[i][0][k] > v], level - 1))

    for _ in range(rounds if rows else 0):
        p = [_sigmoid(s) for s in score]
        grads = [n * q - y for (_, n, y), q in zip(rows, p, strict=True)]
        hess = [n * q * (1 - q) for (_, n, _y), q in zip(rows, p, strict=True)]
        trees.append(grow(range(len(rows)), depth))
    return trees


def tree_value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def calibrate(trees, rows) -> tuple[float, float]:
    """Slope and intercept of the score's log odds, by Newton steps on held-out counts; without any, the score as it is."""
    a, b = 1.0, 0.0
    if not rows:
        return a, b
    scored = [(sum(tree_value(t, x) for t in trees), n, y) for x, n, y in rows]
    for _ in range(25):
        ga = gb = 0.0
        haa = hbb = 1e-3
        hab = 0.0
        ga += 1e-3 * (a - 1)
        gb += 1e-3 * b
        for s, n, y in scored:
            p = _sigmoid(a * s + b)
            r, w = n * p - y, n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + r * s, gb + r, haa + w * s * s, hab + w * s, hbb + w
        det = haa * hbb - hab * hab
        if det < 1e-12:
            break
        a, b = a - (ga * hbb - gb * hab) / det, b - (gb * haa - ga * hab) / det
    return max(a, 0.0), b


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return repr(float(tree)) + "D"
    return f"CASE WHEN c.{FEATURES[tree[0]]} <= {tree[1]} THEN {_tree_sql(tree[2])} ELSE {_tree_sql(tree[3])} END"


def find_personal_data(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    base = base_kinds(F.col("text"))
    mail = F.when(F.rlike("text", F.lit(r"@|[\[(]at[\])]")), match_spans(F.col("text"), MAIL_LIKE, 24)).otherwise(F.array().cast(SPANS))
    t = d.select(
        "doc_id", *[v.alias(k) for k, v in base.items()],
        F.concat(described(mail, 0), described(match_spans(F.col("text"), NUMBER_LIKE, 24), 1)).alias("candidates"),
    )
    every = F.concat(*[F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in KINDS])
    t = t.withColumn("base", every).withColumn("candidates", F.zip_with("candidates", meets(F.col("candidates"), F.col("base")), lambda c, y: c.withField("y", y)))
    t = cut(t, "spans")

    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 0).alias("calibrates")
    seen = t.where(F.size("candidates") > 0).select(fold, F.explode("candidates").alias("c"))
    # few combinations of small whole numbers, whatever the corpus
    table = seen.groupBy("calibrates", *[F.col(f"c.{k}").alias(k) for k in FEATURES]).agg(F.count("*").alias("n"), F.sum("c.y").alias("y")).collect()
    rows = sorted((r.calibrates, tuple(r[k] for k in FEATURES), r.n, int(r.y)) for r in table)
    trees = boost([r[1:] for r in rows if not r[0]])
    a, b = calibrate(trees, [r[1:] for r in rows if r[0]])
    least = math.log(threshold / (1 - threshold))
    if trees:
        total = " + ".join(_tree_sql(x) for x in trees)
        added = F.expr(f"filter(candidates, c -> c.y = 0 AND {a!r}D * ({total}) + {b!r}D >= {least!r}D)")
    else:
        added = F.expr("filter(candidates, c -> false)")
    t = t.withColumn("added", added)

    def written(kind: str) -> Column:
        return F.transform(kind, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))

    named = [written(k) for k in KINDS]
    more = F.transform("added", lambda m: F.concat_ws(":", F.when(m["gen"] == 0, "mail").otherwise("number"), m["start"].cast("string"), m["end"].cast("string")))
    return t.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*named), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(*named, more), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
