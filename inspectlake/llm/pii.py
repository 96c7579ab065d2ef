"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns find e-mail addresses, IP addresses, card and telephone numbers; these base spans always stay.  Looser
patterns propose further candidates: spelled-out addresses, numbers in groups, account and social security numbers.  On
every candidate, base ones included, three labelers vote yes, no or nothing: a strict form (regex), a list of words that
belong to the kind (gazetteer), and cue words before the span (context).  Expectation-maximisation estimates from the
counts of vote patterns how reliable each labeler is; its posteriors train a logistic span classifier over form and
votes, and candidates it accepts are added.

Votes are counted over all documents; only the table of patterns, which has a fixed number of rows, reaches the driver.
Nothing is shuffled but those counts.  Patterns are written so that no text makes them backtrack: runs are possessive and
may only start where a run starts or the last match ended.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inspectlake.llm.common import column, written

#: The base patterns.  ``(?:\G|(?<!x))x++`` matches what ``x+`` does from the left.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Candidates beyond the base: form, pattern and what a text must hold for the pattern to be tried.
LOOSE = (
    ("spelled_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]{1,63}+){1,8}+", r"[\[({]at[\])}]"),
    ("grouped_phone", r"(?<![0-9A-Za-z.+(-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])", r"[0-9][ .-][0-9]{3}"),
    ("social_number", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
)

#: Words of the gazetteer, cue words, and words before numbers that are none.
GAZETTEER = r"(?i)\b(?:com|org|net|edu|gov|info|mail|gmail|outlook|yahoo|hotmail|[a-z]{2})$|^(?:\+?1|\+?49|\+?33|\+?34|\+?44|DE|FR|ES|GB|IT|NL|AT|CH|BE)"
CUES = r"(?i)\b(?:e-?mail|mail|contact|write|reach|call|phone|tel|telephone|mobile|fax|ip|address|server|host|card|visa|account|iban|ssn|social|security|number|kontakt|telefon|konto|correo|courriel)\b[^\p{L}]*(?:\p{L}+[^\p{L}]+)?$"
NO_CUES = r"(?i)\b(?:version|license|licence|isbn|page|pages|chapter|section|figure|table|vol|volume|since|year|in)\b[^\p{L}0-9]*$"
CONTEXT_CHARS = 32


def _found(text: str, pattern: str, guard: str) -> Column:
    """Leftmost matches of ``pattern`` as (a, b, hit): places in code points, and what was matched."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        f"""CASE WHEN {guard} THEN transform(array(struct(split({text}, '{quoted}', -1) AS parts, regexp_extract_all({text}, '{quoted}', 0) AS hits)), x ->
          aggregate(sequence(0, size(x.hits)), struct(0 AS at, cast(array() AS array<struct<a: int, b: int, hit: string>>) AS out),
            (s, i) -> if(i = size(x.hits), s, struct(
              s.at + length(x.parts[i]) + length(x.hits[i]) AS at,
              concat(s.out, array(struct(s.at + length(x.parts[i]) AS a, s.at + length(x.parts[i]) + length(x.hits[i]) AS b, x.hits[i] AS hit))) AS out)),
            s -> s.out))[0] ELSE cast(array() AS array<struct<a: int, b: int, hit: string>>) END"""
    )


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    one = lambda i: digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(one(i))).otherwise(one(i)))
    return total % 10 == 0


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds a column of (a, b, hit) arrays for each base kind to rows with ``text``."""
    text = "text"
    guards = {"email": f"contains({text}, '@')", "ip": f"{text} RLIKE '[0-9][.][0-9]'", "card": f"{text} RLIKE '[0-9](?:[ -]?[0-9]){{15}}'", "phone": f"contains({text}, '+')"}
    out = docs
    for kind, pattern in zip(BASE, (EMAIL, IP, CARD, PHONE)):
        out = out.withColumn(kind, _found(text, pattern, guards[kind]))
    ok = {
        "email": None,
        "ip": lambda x: x["hit"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda x: F.length(_digits(x["hit"])).between(16, 19) & _luhn(_digits(x["hit"])),
        "phone": lambda x: F.length(_digits(x["hit"])).between(8, 15),
    }
    return out.withColumns({k: F.filter(k, test) for k, test in ok.items() if test})


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: kind, a, b and the three votes (1, 0 or -1 for nothing) of every candidate.

    Looser candidates that touch a base span, or one before them in the list of forms, are left out.
    """
    own = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    rows = base_spans(own)
    for form, pattern, need in LOOSE:
        rows = rows.withColumn(form, _found("text", pattern, "text RLIKE '{}'".format(need.replace("\\", "\\\\"))))
    taken: list[str] = list(BASE)
    for form, _, _ in LOOSE:
        rows = rows.withColumn(form, F.filter(form, _apart(tuple(taken))))
        taken.append(form)
    before = lambda x: F.col("text").substr(F.greatest(x["a"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["a"], F.lit(CONTEXT_CHARS)))

    def voted(kind: str):
        if kind in BASE:
            strict = lambda x: F.lit(1)
        elif kind == "grouped_phone":
            strict = lambda x: F.when(F.length(_digits(x["hit"])).between(10, 11), 1).when(F.length(_digits(x["hit"])) < 9, 0).otherwise(-1)
        elif kind == "social_number":
            strict = lambda x: F.when(x["hit"].rlike("^(?:000|666|9)|-00-|-0000$"), 0).otherwise(1)
        elif kind == "account":
            strict = lambda x: F.when(F.length(F.replace(x["hit"], F.lit(" "))).between(15, 34), -1).otherwise(0)
        else:
            strict = lambda x: F.lit(1)
        return lambda x: F.struct(
            F.lit(kind).alias("kind"),
            x["a"].alias("a"),
            x["b"].alias("b"),
            strict(x).cast("int").alias("form"),
            F.when(x["hit"].rlike(GAZETTEER), 1).otherwise(-1).alias("list"),
            F.when(before(x).rlike(CUES), 1).when(before(x).rlike(NO_CUES), 0).otherwise(-1).alias("cue"),
        )

    kinds = [*BASE, *[form for form, _, _ in LOOSE]]
    return rows.select("doc_id", F.flatten(F.array(*[F.transform(k, voted(k)) for k in kinds])).alias("spans"))


def _apart(taken: tuple[str, ...]):
    """A test that a span touches none of the spans of these columns."""

    def touches(x: Column, kind: str) -> Column:
        return F.exists(kind, lambda y: (y["a"] < x["b"]) & (x["a"] < y["b"]))

    return lambda x: ~reduce(Column.__or__, [touches(x, kind) for kind in taken])


VOTES = ("form", "list", "cue")


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 100) -> tuple[dict[tuple[int, ...], float], float, list[dict]]:
    """Expectation-maximisation over vote patterns: posteriors, share of true candidates, and by labeler P(vote | truth).

    The start says that votes are right more often than not; a vote of nothing tells nothing at first.
    """
    prior = 0.5
    rates = [{t: {1: 0.6 if t else 0.2, 0: 0.2 if t else 0.6, -1: 0.2} for t in (0, 1)} for _ in VOTES]
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes in counts:
            odds = [math.log(max(1e-9, p)) + sum(math.log(max(1e-9, r[t][v])) for r, v in zip(rates, votes)) for t, p in ((0, 1 - prior), (1, prior))]
            posterior[votes] = 1 / (1 + math.exp(min(500.0, odds[0] - odds[1])))
        total = sum(counts.values())
        prior = (sum(counts[v] * posterior[v] for v in counts) + 1) / (total + 2)
        for j, rate in enumerate(rates):
            for t in (0, 1):
                weight = {v: 1.0 for v in (1, 0, -1)}
                weight[t] += 4.0
                for votes, n in counts.items():
                    weight[votes[j]] += n * (posterior[votes] if t else 1 - posterior[votes])
                rate[t] = {v: w / sum(weight.values()) for v, w in weight.items()}
    return posterior, prior, rates


def span_features(kind, votes) -> list[str]:
    return [f"kind={kind}", *[f"{name}={v}" for name, v in zip(VOTES, votes)]]


def fit_classifier(cells: dict[tuple[str, tuple[int, ...]], float], posterior: dict[tuple[int, ...], float], rounds: int = 400) -> dict[str, float]:
    """Logistic weights by feature from the posteriors of vote patterns; "" is the intercept."""
    weights: dict[str, float] = {"": 0.0}
    total = sum(cells.values()) or 1.0
    squares: dict[str, float] = {}
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for (kind, votes), n in cells.items():
            names = ["", *span_features(kind, votes)]
            gap = posterior[votes] - 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in names)))))
            for f in names:
                slope[f] = slope.get(f, 0.0) + gap * n / total
        for f, g in slope.items():
            g -= 1e-3 * weights.get(f, 0.0)
            squares[f] = squares.get(f, 1e-10) + g * g
            weights[f] = weights.get(f, 0.0) + 0.3 * g / math.sqrt(squares[f])
    return weights


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` lists kind:start:end of base spans and accepted candidates, by kind in listed order, then start; places are
    code points, the end exclusive.  Null and empty texts have no spans; their digest is that of the empty string.
    """
    rows = written(candidates(docs), "candidates")
    counted = rows.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{v}" for v in VOTES]).count().collect()
    cells = {(r["kind"], tuple(r[v] for v in VOTES)): float(r["count"]) for r in counted}
    patterns: dict[tuple[int, ...], float] = {}
    for (_, votes), n in cells.items():
        patterns[votes] = patterns.get(votes, 0.0) + n
    weights = fit_classifier(cells, reliabilities(patterns)[0])

    def accepted(x: Column) -> Column:
        score = F.lit(weights[""])
        for name, value in weights.items():
            if name:
                what, _, level = name.partition("=")
                score = score + F.when(x[what] == (level if what == "kind" else int(level)), value).otherwise(0.0)
        return x["kind"].isin(*BASE) | (1 / (1 + F.exp(-score)) >= least)

    text = lambda x: F.concat_ws(":", x["kind"], x["a"], x["b"])
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[kind(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(F.filter("spans", accepted), text), ",").alias("spans"),
    )
