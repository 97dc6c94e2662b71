"""Personal data by weak supervision, in DataFrame functions only.

Method. Patterns propose spans. Labelers vote on each of them, for, against or not at all:

* ``pattern``: the strict form of its kind (ranges of addresses, digit counts, check digits);
* ``gazetteer``: a cue word of its kind shortly before it, from the lists below;
* ``counter``: a word shortly before it that names something else (a version, a page, a licence);
* ``context``: letters or digits touch it, so that it is part of something longer;
* ``shape``: the usual grouping of its kind, or against it a run of one repeated digit.

Expectation-maximisation over the counts of vote patterns, of which there are at most 3^5, gives
the share of personal data and each labeler's reliability without a labelled span. Its posteriors
train the final classifier, a logistic unit over kind, digits, grouping and surroundings, on the
counts of feature and vote combinations. A span stays if it passes the strict form of its kind
(base spans: they are exact rules) or if the classifier says so.

Offsets come from the pieces between matches, so texts are read once, in the JVM; nothing of a
text is shuffled.

Defined cases: a null text is empty; kinds are searched independently, so spans of different kinds
may overlap (``mask`` then covers both with the name of the first); proposals that overlap a base span
add nothing; without any proposal the model is the prior; other columns, whatever their names, are
ignored by ``find`` and kept by ``mask``; repeated rows get equal rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen.llm.common import cut_lineage, read

KINDS = ["email", "ip", "card", "phone", "ssn", "secret"]
BASE_KINDS = KINDS[:4]

# Possessive forms of the fixed patterns: same leftmost matches, linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals beyond the fixed patterns; ``NEEDS`` has in the same order what a match always holds.
MORE = [
    ("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{{1,63}}+"
              r"(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"(?i)(?:password|passwd|secret|token|api[_-]?key)\x20{0,2}+[=:]\x20{0,2}+\"?[A-Z0-9_/+-]{12,128}+\"?"),
    ("secret", r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])"),
]
NEEDS = [r"[\[(] ?(?:at|AT) ?[\])]", "[0-9]", "[0-9]", "(?i)password|passwd|secret|token|api[_-]?key", "AKIA"]

CUES = {
    "email": ["mail", "contact", "write to", "@", "courriel", "correo"],
    "ip": ["ip", "host", "server", "address", "login", "ping"],
    "card": ["card", "visa", "credit", "debit", "karte", "carte", "tarjeta", "iban"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "anruf", "appel", "llam"],
    "ssn": ["ssn", "social", "security", "tax"],
    "secret": ["password", "passwd", "secret", "token", "key", "akia", "login"],
}
COUNTER = ["version", "release", "page", "chapter", "section", "license", "licence", "isbn", "order", "figure", "year"]
#: Characters before a span in which cue words count.
REACH = 32

LABELERS = ["pattern", "gazetteer", "counter", "context", "shape"]
FEATURES = ["kind", "digits", "grouped", "left", "right", "cue"]


def _spans(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and said of the matches, left to right."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said"))
    return F.aggregate(
        pairs, F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start: int, end: int, said: string>>))"),
        lambda acc, x: F.when(x["said"].isNull(), acc).otherwise(F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["said"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["said"])).alias("end"),
                x["said"].alias("said")))).alias("out"))),
        lambda acc: acc["out"])


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"


def strict(kind: str, said: Column) -> Column:
    """Whether a match of a fixed pattern is a base span."""
    if kind == "ip":
        return said.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        n = F.length(_digits(said))
        return F.when(n.between(12, 19), _luhn(_digits(said))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(said)).between(9, 15)
    return F.lit(True)


def _empty() -> Column:
    return F.expr("cast(array() as array<struct<start: int, end: int, said: string>>)")


def _class(c: Column) -> Column:
    return (F.when(c == "", "end").when(c.rlike("^[\\p{L}\\p{N}_]"), "word")
            .when(c.rlike(r"^\s"), "space").otherwise("sign"))


def _described(text: Column, spans: Column, kind: str, fixed: bool) -> Column:
    """Spans with their votes and features."""
    def one(s: Column) -> Column:
        said = s["said"]
        digits = _digits(said)
        before = F.lower(F.substring(text, F.greatest(s["start"] - REACH, F.lit(0)) + 1,
                                     F.least(s["start"], F.lit(REACH))))
        left = _class(F.right(before, F.lit(1)))
        right = _class(F.substring(text, s["end"] + 1, F.lit(1)))
        # A secret names itself.
        near = F.concat(before, F.lower(said)) if kind == "secret" else before
        cue = F.lit(False)
        for word in CUES[kind]:
            cue = cue | F.contains(near, F.lit(word))
        counter = F.lit(False)
        for word in COUNTER:
            counter = counter | F.contains(before, F.lit(word))
        passed = strict(kind, said) if fixed else F.lit(kind != "card")
        grouped = said.rlike("[^0-9A-Za-z]")
        touched = (left == "word") | (right == "word")
        same = said.rlike(r"([0-9])(?:[^0-9A-Za-z]*\1){7}")
        vote = F.concat(
            F.when(passed, "1").otherwise("0"), F.when(cue, "1").otherwise("-"), F.when(counter, "0").otherwise("-"),
            F.when(touched, "0").otherwise("-"), F.when(same, "0").when(grouped, "1").otherwise("-"))
        n = F.length(digits)
        size = (F.when(n == 0, "0").when(n < 8, "1-7").when(n < 12, "8-11").when(n < 16, "12-15")
                .when(n < 20, "16-19").otherwise("20+"))
        return F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"),
            (passed & F.lit(fixed)).alias("base"), vote.alias("votes"),
            F.array(F.when(passed, kind).otherwise(f"{kind}, not strict"), size, grouped.cast("string"), left, right, cue.cast("string")).alias("features"))

    return F.transform(spans, one)


def _worth_a_vote(s: Column) -> Column:
    """Failed matches of the fixed patterns are mostly other numbers: only those that a cue word names, or
    that are too long for one number and written in groups, are proposed."""
    size, grouped, cue = (F.get(s["features"], F.lit(FEATURES.index(f))) for f in ("digits", "grouped", "cue"))
    return s["base"] | (cue == "true") | ((size == "20+") & (grouped == "true"))


def proposals(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, text (null: empty) and ``proposed``: all spans with votes and features."""
    text = F.col("text")
    # What a text must hold for a pattern to match is tested once a text, in a projection of its
    # own: most texts hold none of it and go no further.
    own = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).withColumns({
        "_at": F.contains(text, F.lit("@")), "_plus": F.contains(text, F.lit("+")), "_digit": text.rlike("[0-9]"),
        **{f"_n{i}": text.rlike(need) for i, need in enumerate(NEEDS) if need != "[0-9]"}})
    digit = F.col("_digit")
    # Each pattern has a gate of its own: kinds have patterns that need different characters.
    gates = [F.col("_at"), digit, digit, F.col("_plus") & digit,
             *[digit if need == "[0-9]" else F.col(f"_n{i}") for i, need in enumerate(NEEDS)]]
    found, described = {}, []
    for i, ((kind, pattern), gate) in enumerate(zip([*PATTERNS.items(), *MORE], gates, strict=True)):
        fixed = i < len(PATTERNS)
        found[f"_s{i}"] = F.when(gate, _spans(text, pattern)).otherwise(_empty())
        one = _described(text, F.col(f"_s{i}"), kind, fixed)
        described.append(F.filter(one, _worth_a_vote) if fixed else one)
    # Matches are found in one projection and described in the next one, so each is found once.
    all_spans = own.withColumns(found).withColumn("_all", F.concat(*described)).drop(
        *found, "_at", "_plus", "_digit", *[f"_n{i}" for i in range(len(NEEDS))])
    base = F.filter("_all", lambda s: s["base"])
    rest = F.filter("_all", lambda s: ~s["base"])
    return (all_spans.withColumn("_base", base).withColumn("_rest", rest)
            .withColumn("proposed", F.sort_array(F.concat("_base", F.filter("_rest", lambda s: ~F.exists(
                "_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))))
            .drop("_all", "_base", "_rest"))


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier by (feature, value), its bias, and what EM found."""

    weights: dict[tuple[str, str], float]
    bias: float
    prior: float
    reliability: dict[str, tuple[float, float]]

    def score(self, features: Column) -> Column:
        total = F.lit(self.bias)
        for i, name in enumerate(FEATURES):
            own = [x for (n, v), w in sorted(self.weights.items()) if n == name for x in (F.lit(v), F.lit(w))]
            if own:
                total = total + F.coalesce(F.try_element_at(F.create_map(*own), F.get(features, F.lit(i))), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def expectation_maximisation(counts: dict[str, float], rounds: int = 50) -> tuple[float, list[tuple[float, float]], dict[str, float]]:
    """(prior, (votes for | personal, votes against | not) by labeler, posterior by vote pattern).

    Labelers are independent given the truth; silence says nothing. Counts are smoothed by one.
    """
    n = len(LABELERS)
    prior, rates = 0.5, [(0.8, 0.8)] * n
    posterior: dict[str, float] = {}
    for _ in range(rounds):
        for votes in counts:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (tp, tn) in zip(votes, rates, strict=True):
                if v == "1":
                    yes, no = yes + math.log(tp), no + math.log(1 - tn)
                elif v == "0":
                    yes, no = yes + math.log(1 - tp), no + math.log(tn)
            posterior[votes] = 1 / (1 + math.exp(min(50.0, max(-50.0, no - yes))))
        total = sum(counts.values())
        prior = (sum(c * posterior[v] for v, c in counts.items()) + 1) / (total + 2)
        rates = []
        for i in range(n):
            for_yes = sum(c * posterior[v] for v, c in counts.items() if v[i] == "1")
            all_yes = sum(c * posterior[v] for v, c in counts.items() if v[i] != "-")
            against_no = sum(c * (1 - posterior[v]) for v, c in counts.items() if v[i] == "0")
            all_no = sum(c * (1 - posterior[v]) for v, c in counts.items() if v[i] != "-")
            # A labeler is never worse than chance: personal data is the class they vote for.
            rates.append((min(0.99, max(0.5, (for_yes + 1) / (all_yes + 2))),
                          min(0.99, max(0.5, (against_no + 1) / (all_no + 2)))))
    return prior, rates, posterior


def train(counts: dict[tuple[str, tuple[str, ...]], float], rounds: int = 300) -> Model:
    """EM over the votes, then a logistic unit over the features with the posteriors as labels."""
    votes: dict[str, float] = {}
    for (v, _), c in counts.items():
        votes[v] = votes.get(v, 0.0) + c
    prior, rates, posterior = expectation_maximisation(votes)
    rows = [([(n, f) for n, f in zip(FEATURES, fs, strict=True)], c, posterior[v]) for (v, fs), c in counts.items()]
    total = sum(c for _, c, _ in rows) or 1.0
    weights = {x: 0.0 for own, _, _ in rows for x in own}
    bias = math.log(prior / (1 - prior))
    for _ in range(rounds):
        slope, base = dict.fromkeys(weights, 0.0), 0.0
        for own, c, y in rows:
            miss = c / total * (y - 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + sum(weights[x] for x in own))))))
            base += miss
            for x in own:
                slope[x] += miss
        bias += base
        for x, g in slope.items():
            weights[x] += 2.0 * (g - 1e-3 * weights[x])
    return Model(weights, bias, prior, dict(zip(LABELERS, rates, strict=True)))


def learn(proposed: DataFrame) -> Model:
    """Reads only counts: combinations of votes and features, a few thousand at most."""
    rows = (proposed.select(F.explode("proposed").alias("s"))
            .groupBy("s.votes", "s.features").agg(F.count(F.lit(1)).alias("n")).collect())
    return train({(r.votes, tuple(r.features)): float(r.n) for r in rows})


def _decided(model: Model, threshold: float) -> Column:
    return F.filter("proposed", lambda s: s["base"] | (model.score(s["features"]) >= threshold))


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and ``spans`` (start, rank of the kind, end, base, ..), by start and kind."""
    proposed = cut_lineage(proposals(docs, "doc_id").select("doc_id", "proposed"))
    return proposed.select("doc_id", _decided(learn(proposed), threshold).alias("spans"))


def mask(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>`` and n_chars, where there is one, renewed."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    # The row travels as one column, so no column of the table can clash with those made here. Written
    # once: the search is the costly part, and learning needs it before anything can be decided.
    own = cut_lineage(proposals(docs.select(F.struct(*docs.columns).alias("row"), "text"), "row").select("row", "proposed"))
    model = learn(own)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    put = F.aggregate(
        _decided(model, threshold), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                         F.get(names, s["rank"])).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    masked = own.select("row", F.when(F.size("proposed") > 0, put).otherwise(F.col("row.text")).alias("masked"))
    made = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return masked.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _said(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    def number(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["rank"] == rank))).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_said(base), 256).alias("base_sha256"),
                        _said(F.col("spans")).alias("spans"))
