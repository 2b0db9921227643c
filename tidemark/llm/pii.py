"""Personal data by weak supervision, in SQL functions only.

*Candidates.* The base kinds (email, ip, card, phone) are fixed patterns with
fixed checks; spans that pass are always kept. Wider patterns propose further
spans: digit groups like identity numbers, access tokens and keys, values
assigned to a password or key, and host-less mail addresses.

*Labelers.* Five labelers vote yes, no or abstain on every candidate: a strict
pattern, the shape of the span (digits, letters, length), a gazetteer of
provider and key names, context words before the span, and the characters
around it.

*Aggregation.* Expectation-maximisation over the counts of vote patterns
estimates the share of true candidates and each labeler's reliability; base
spans count as true. Its posteriors, as soft labels, train a logistic regression over the kind, the votes
and features of the span (length, share of digits) and of the characters beside
it. A proposed span is added if the regression gives it 0.5 or more and it
overlaps no base span.

*Scale.* One scan finds the candidates of each text within its row. Vote
patterns are counted by Spark; at most 3^5 * 4^4 * kinds of them exist (some
hundreds occur), and only these counts reach the driver, where both fits run. No
Python runs on the executors.

Defined cases: a null text is empty; a text without spans has an empty list;
equal spans of two kinds are both kept; repeated rows are searched each; a very
long text is searched whole, in its row; on an empty table nothing is fitted and
the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from itertools import product
from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality_rules import let

# Fixed patterns of the base kinds. Possessive and anchored at the start of a
# run of characters (or the end of the last match), they find what the plain
# patterns find without trying every later start in a long run again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

# Wider patterns that only propose spans.
PROPOSED = {
    "token": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:gh[a-z]_|xox[a-z]-|AIza|sk-)[A-Za-z0-9_-]{16,}+"
    r"|(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+|[A-Za-z]{24,}+|[0-9]{24,}+)(?![A-Za-z0-9])",
    "secret": r"(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\x20?[=:]\x20?[\"']?)[^\s\"',;=:]{6,}+",
    "account": r"(?<![A-Za-z0-9.-])[0-9]{2,4}(?:[\x20-][0-9]{2,6}){1,4}(?![A-Za-z0-9-])",
    "mailbox": r"(?<![A-Za-z0-9._%+@-])[A-Za-z][A-Za-z0-9._%+-]{1,63}@[A-Za-z0-9-]{2,63}(?![A-Za-z0-9.@-])",
}

# Words that name providers, keys and ways to reach a person.
GAZETTEER = r"(?i)(mail|gmail|yahoo|outlook|hotmail|proton|example|localhost|token|secret|passw|apikey|api_key|bearer|iban|ssn|account|passport)"
CONTEXT = r"(?i)(e-?mail|contact|write to|call|phone|tel|fax|mobile|token|secret|key|password|bearer|ssn|iban|account|passport|card|id)\W{1,6}$"
# An assignment to a name of a secret, and prefixes of issued access keys.
ASSIGNED = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s?[=:]\s?[\"']?$"
ISSUED = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[a-z]_[A-Za-z0-9]{36,}|xox[a-z]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,})$"
REACH = 24
LABELERS = ("pattern", "shape", "gazetteer", "context", "border")
FEATURES = ("length", "digits", "left", "right")

SPAN = "kind string, start int, end int, text string"
_NONE = "array<struct<kind:string,start:int,end:int,text:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def weigh(d: Column) -> Column:
        value = lambda i: F.substring(d, -(i + 1), F.lit(1)).cast("int") * (1 + i % 2)
        total = F.aggregate(
            F.sequence(F.lit(0), F.char_length(d) - 1),
            F.lit(0),
            lambda a, i: a + value(i) - F.when(value(i) > 9, F.lit(9)).otherwise(F.lit(0)),
        )
        return F.when(F.char_length(d).between(14, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(_digits(m), weigh)


def _byte_parts(m: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.char_length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(256)) <= 255))


def _found(text: Column, kind: str, pattern: str, good, worth: Column) -> Column:
    """All matches in order with their code point offsets; then those that are ``good``."""

    def place(parts: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), parts.alias("before")),
            F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out")),
            lambda a, x: F.when(x["m"].isNull(), a).otherwise(
                let(
                    a["at"] + F.char_length(x["before"]),
                    lambda start: F.struct(
                        (start + F.char_length(x["m"])).alias("at"),
                        F.array_append(
                            a["out"],
                            F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(x["m"])).alias("end"), x["m"].alias("text")),
                        ).cast(_NONE).alias("out"),
                    ),
                )
            ),
            lambda a: a["out"],
        )

    spans = let(F.split(text, pattern, -1), place)
    return F.when(worth, F.filter(spans, good)).otherwise(F.array().cast(_NONE))


def base_spans(text: Column) -> list[Column]:
    """For each base kind the array of its spans."""
    length = lambda s: F.char_length(_digits(s["text"]))
    return [
        _found(text, "email", EMAIL, lambda s: F.lit(True), F.contains(text, F.lit("@"))),
        _found(text, "ip", IP, lambda s: _byte_parts(s["text"]), text.rlike(r"[0-9]\.[0-9]")),
        _found(text, "card", CARD, lambda s: _luhn(s["text"]), text.rlike(r"[0-9][0-9\x20-]{12}")),
        _found(text, "phone", PHONE, lambda s: length(s).between(10, 15), text.rlike(r"\+[0-9]")),
    ]


def proposed_spans(text: Column) -> Column:
    worth = {
        "token": text.rlike(PROPOSED["token"]),
        "secret": text.rlike("(?i)passw|pwd|secret|token|api[_-]?key"),
        "account": text.rlike(PROPOSED["account"]),
        "mailbox": F.contains(text, F.lit("@")),
    }
    return F.concat(*[_found(text, k, p, lambda s: F.lit(True), worth[k]) for k, p in PROPOSED.items()])


def _votes(text: Column, s: Column) -> Column:
    """One digit a labeler (0 no, 1 abstain, 2 yes), then one a feature of the span and of its context (0 to 3)."""
    m, kind = s["text"], s["kind"]
    n_digits = F.char_length(_digits(m))
    n = F.char_length(m)
    before = F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - REACH), F.least(F.lit(REACH), s["start"]))
    left = F.substring(text, s["start"], F.lit(1))
    right = F.substring(text, s["end"] + 1, F.lit(1))
    strict = (
        F.when(kind.isin(*KINDS), F.lit(2))
        .when((kind == "token") & (m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | m.rlike(ISSUED)), F.lit(2))
        .when(kind.isin("token", "secret") & before.rlike(ASSIGNED), F.lit(2))
        .when((kind == "account") & m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit(2))
        .when(kind == "mailbox", F.lit(1))
        .otherwise(F.lit(0))
    )
    share = n_digits / n
    shape = (
        F.when(kind.isin("token", "secret"), F.when((m.rlike("[A-Za-z]") & (n_digits >= 1)) | m.rlike(ISSUED), F.lit(2)).when(kind == "secret", F.lit(1)).otherwise(F.lit(0)))
        .when(kind.isin("account", "card", "phone"), F.when(n_digits.between(9, 19), F.lit(2)).otherwise(F.lit(0)))
        .when(kind == "ip", F.lit(2))
        .otherwise(F.when(m.rlike(r"[0-9._]"), F.lit(2)).otherwise(F.lit(1)))
    )
    gazetteer = F.when(F.concat(before, m).rlike(GAZETTEER), F.lit(2)).otherwise(F.lit(1))
    context = F.when(before.rlike(CONTEXT), F.lit(2)).otherwise(F.lit(1))
    quiet = lambda c: (c == "") | c.rlike(r"[\s\"'(),;:!?.<>\[\]]")
    border = F.when(quiet(left) & quiet(right), F.lit(2)).when(left.rlike("[A-Za-z0-9]") | right.rlike("[A-Za-z0-9]"), F.lit(0)).otherwise(F.lit(1))
    side = lambda c: F.when((c == "") | c.rlike(r"\s"), F.lit(0)).when(c.rlike("[\"'=:(\\[]"), F.lit(1)).when(c.rlike("[A-Za-z0-9]"), F.lit(2)).otherwise(F.lit(3))
    length = F.when(n < 8, F.lit(0)).when(n < 16, F.lit(1)).when(n < 32, F.lit(2)).otherwise(F.lit(3))
    digits = F.when(share == 0, F.lit(0)).when(share < 0.5, F.lit(1)).when(share < 1, F.lit(2)).otherwise(F.lit(3))
    return F.concat(*[v.cast("string") for v in (strict, shape, gazetteer, context, border, length, digits, side(left), side(right))])


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base spans by kind, and all candidates with their votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("__t"), *[c.alias(f"n_{k}") for k, c in zip(KINDS, base_spans(text))], proposed_spans(text).alias("proposed"))
    t = F.col("__t")
    base = F.concat(*[F.col(f"n_{k}") for k in KINDS])
    overlap = lambda s: F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) | (
        (s["kind"] == "secret") & F.exists(F.col("proposed"), lambda b: (b["kind"] == "token") & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    vote = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), _votes(t, s).alias("votes"))
    return (
        found.withColumn("base", base)
        .withColumn("proposed", F.filter("proposed", lambda s: ~overlap(s)))
        .select(
            "doc_id",
            *[F.size(f"n_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
            F.transform("base", vote).alias("base"),
            F.transform("proposed", vote).alias("proposed"),
        )
    )


def reliabilities(patterns: dict[str, int], sure: dict[str, int] | None = None, rounds: int = 60) -> tuple[float, list[list[list[float]]], dict[str, float]]:
    """EM over counts of vote patterns: the share of true candidates, P(vote | truth) by labeler, posteriors.

    ``sure`` are counts of spans known to be true (the base spans, which passed
    their checks): they hold the class of true spans in its place, where votes
    alone could as well divide spans by kind. A labeler is taken to be no worse
    than chance: its yes never counts against a span, its no never for it, and an
    abstention says nothing. Starts from the majority of the votes; every estimate
    has one added count, so no vote becomes impossible.
    """
    sure = sure or {}
    post = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(int(x) - 1 for x in v))) for v in patterns}
    share, table = 0.5, []
    for _ in range(rounds):
        mass = [1.0 + sum(n * (post[v] if y else 1 - post[v]) for v, n in patterns.items()) for y in (0, 1)]
        share = mass[1] / sum(mass)
        mass[1] += sum(sure.values())
        table = [
            [
                [(1.0 + sum(n * (post[v] if y else 1 - post[v]) for v, n in patterns.items() if v[k] == x) + y * sum(n for v, n in sure.items() if v[k] == x)) / (2.0 + mass[y]) for x in "012"]
                for y in (0, 1)
            ]
            for k in range(len(LABELERS))
        ]
        for v in patterns:
            odds = log(share / (1 - share))
            for k, x in enumerate(v):
                said = log(table[k][1][int(x)] / table[k][0][int(x)])
                odds += max(0.0, said) if x == "2" else min(0.0, said) if x == "0" else 0.0
            post[v] = 1 / (1 + exp(min(700.0, -odds)))
    return share, table, post


def _features(kind: str, pattern: str) -> list[int]:
    """Places of a pattern's features: its kind, then each digit."""
    names = [*KINDS, *PROPOSED]
    return [names.index(kind), *(len(names) + 4 * k + int(x) for k, x in enumerate(pattern))]


def train(patterns: dict[tuple[str, str], int], post: dict[str, float], rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> list[float]:
    """Logistic regression on soft labels (base spans are true), by gradient descent over distinct (kind, pattern)."""
    size = len(KINDS) + len(PROPOSED) + 4 * (len(LABELERS) + len(FEATURES))
    rows = sorted(patterns.items())
    x = np.zeros((len(rows), size))
    for i, ((kind, pattern), _) in enumerate(rows):
        x[i, _features(kind, pattern)] = 1
    y = np.array([1.0 if kind in KINDS else post[v[: len(LABELERS)]] for (kind, v), _ in rows])
    n = np.array([c for _, c in rows], float) / sum(patterns.values())
    w = np.zeros(size)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (n * (p - y)) + decay * w)
    return w.tolist()


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans``: base spans, and all spans with their scores."""
    found = materialize(candidates(docs), "pii")
    counted = (
        found.select(F.explode(F.concat("base", "proposed")).alias("s")).groupBy("s.kind", "s.votes").count().collect()
    )  # at most 3 ** 5 * 4 ** 4 patterns a kind
    patterns = {(r["kind"], r["votes"]): r["count"] for r in counted}
    votes: dict[str, int] = {}
    sure: dict[str, int] = {}
    for (kind, v), n in patterns.items():
        of = sure if kind in KINDS else votes
        of[v[: len(LABELERS)]] = of.get(v[: len(LABELERS)], 0) + n
    names = [*KINDS, *PROPOSED]
    weights = train(patterns, reliabilities(votes, sure)[2]) if patterns else [0.0] * (len(names) + 4 * (len(LABELERS) + len(FEATURES)))

    def score(s: Column) -> Column:
        terms = [F.element_at(F.array(*[F.lit(x) for x in weights[: len(names)]]), _rank(s["kind"]) + 1)]
        for k in range(len(LABELERS) + len(FEATURES)):
            of = weights[len(names) + 4 * k : len(names) + 4 * k + 4]
            terms.append(F.element_at(F.array(*[F.lit(x) for x in of]), F.substring(s["votes"], k + 1, 1).cast("int") + 1))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum(terms[1:], terms[0])))

    out = lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"), score(s).alias("score"))
    added = F.filter("proposed", lambda s: score(s) >= 0.5)
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sort_array(F.transform("base", out)).alias("base"),
        F.sort_array(F.transform(F.concat(F.col("base"), added), out)).alias("spans"),
    )


def _rank(kind: Column) -> Column:
    names = [*KINDS, *PROPOSED]
    out = F.lit(len(names))
    for i, k in enumerate(names):
        out = F.when(kind == k, F.lit(i)).otherwise(out)
    return out


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Texts with every span replaced by its kind in brackets: ``doc_id, text``. Rows are known by their place, so doc_ids may repeat or be null."""
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", F.col("text").cast("string").alias("text")), "rows")
    spans = find(keyed.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    return keyed.join(spans, "__row").select("doc_id", cut.alias("text"))


def every_pattern() -> list[str]:
    """All vote patterns, for tests of the bound."""
    return ["".join(p) for p in product("012", repeat=len(LABELERS))]
