"""Personal data by weak supervision, with DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; wider patterns add candidates. Four labelers vote
on each candidate (for, against, or nothing): the base pattern with its checks, gazetteers (domain endings, calling codes, card
issuers, reserved address blocks), trigger words in the context on both sides, and the signs that touch it. Beside the votes a
candidate has features of its span: its length, its separators, its longest run of digits, and whether its parts are grouped as
such data are. The counts of the patterns of votes and features reach the driver, `MOST_CELLS` rows at most however large the
corpus is: expectation-maximisation estimates each labeler's reliability and each kind's rate from the votes, and a logistic
classifier of each kind's features and the votes is fitted to the posteriors. Its weights score every candidate in the second
DataFrame step. Base spans stay whatever the score; others are added from `threshold` on if they overlap no base span.

Places are code points, ends exclusive. Patterns are written with possessive quantifiers and starts that a run can't have in
its middle, so long runs take time in proportion to their length.

Defined cases: null and empty texts have no spans; repeated rows have the same spans; without candidates nothing is fitted and
nothing added; an empty table gives an empty result; redact() keeps all columns and leaves null texts null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

KINDS = ("email", "ip", "card", "phone")

#: Base patterns; each finds what the plain form in the comment finds, leftmost and non-overlapping.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: A sign that a text must have for the pattern to be tried.
NEEDS = {("base", "email"): ("@",), ("base", "phone"): ("+",), ("base", "ip"): (".",), ("wider", "email"): ("(at)", "[at]"), ("wider", "ip"): (":",)}

#: Gazetteers and trigger words. Any two letters count as a country's ending.
ENDINGS = "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev cloud online shop site store tech blog example test"
#: The country calling codes as numbering zones: a zone's two-digit codes, all other tens of it being of three digits.
CALLING_CODES = "1|7|2(?:0|7|[1-69][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[0578][0-9])|9(?:[0-58]|[679][0-9])"
TRIGGERS = {
    "email": "mail email e-mail mailto contact contacto contacter write reach courriel courrier adresse correo escribe escribir kontakt schreiben schreib address",
    "ip": "ip ipv4 ipv6 address addr host server client login ping adresse serveur servidor dirección rechner",
    "card": "card cards visa credit debit mastercard amex discover payment carte bancaire paiement karte kreditkarte zahlung tarjeta crédito pago",
    "phone": "phone tel call calls mobile cell fax telephone whatsapp sms reach téléphone appeler appelez portable telefon anrufen handy rufnummer teléfono llamar móvil",
}
AGAINST = "version release build isbn issn order invoice chapter section commande facture bestellung rechnung pedido factura serial article figure"
#: Characters of context before and after a candidate.
CONTEXT, CONTEXT_AFTER = 40, 25
LABELERS = ("pattern", "gazetteer", "context", "touch")
#: Features of a span and how many values each has.
FEATURES = {"size": 4, "marks": 4, "run": 4, "grouped": 2}
MOST_CELLS = len(KINDS) * 3 ** len(LABELERS) * 4 * 4 * 4 * 2


def _found(text: Column, pattern: str, keep) -> Column:
    """Spans (start, end, match) of the matches for which keep is true: what lies between matches gives their places."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.array().cast("array<struct<start:long,end:long,match:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["between"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(keep(pair["match"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.filter(F.arrays_zip(between.alias("between"), matches.alias("match")), lambda p: p["match"].isNotNull())
    spans = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), zero.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), spans).otherwise(zero)


def _gated(text: Column, source: str, kind: str, keep) -> Column:
    spans = _found(text, (BASE if source == "base" else WIDER)[kind], keep)
    signs = NEEDS.get((source, kind))
    if not signs:
        return spans
    has = F.lit(False)
    for s in signs:
        has = has | F.contains(text, F.lit(s))
    return F.when(has, spans).otherwise(F.array().cast("array<struct<start:long,end:long,match:string>>"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _valid(kind: str, match: Column) -> Column:
    """The checks of a base match."""
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(match)).between(16, 19), F.call_function("luhn_check", _digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _worth(kind: str, match: Column) -> Column:
    """Base matches that fail their checks but are candidates: near enough to what they look like."""
    if kind == "card":
        return F.length(_digits(match)).between(13, 19)
    return F.lit(True)


def _gazetteer(kind: str, match: Column) -> Column:
    if kind == "email":
        good = F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1)).rlike(f"^(?:[a-z]{{2}}|{'|'.join(ENDINGS.split())})$")
    elif kind == "ip":
        good = ~match.rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\.|^0*0:")
    elif kind == "card":
        good = match.rlike("^[3-6]")
    else:
        good = F.when(match.startswith("+"), _digits(match).rlike(f"^(?:{CALLING_CODES})")).otherwise(F.regexp_extract(match, "([0-9]{3})", 1).rlike("^[2-9]"))
    return F.when(good, 1).otherwise(-1)


def _context(kind: str, text: Column, start: Column, end: Column) -> Column:
    before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT).cast("long")))
    near = F.lower(F.concat(before, F.lit(" \x00 "), F.substring(text, end + 1, F.lit(CONTEXT_AFTER).cast("long"))))
    has = lambda words: near.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(words.split()) + r")(?![\p{L}\p{N}])")
    return F.when(has(TRIGGERS[kind]), 1).when(has(AGAINST), -1).otherwise(0)


#: What the parts of a span look like where it is what it seems.
GROUPED = {
    "email": r"^[A-Za-z0-9](?:[._%+-]?[A-Za-z0-9])*+ ?(?:@|[\[(]at[\])])",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}|^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
}


def _features(kind: str, match: Column) -> dict[str, Column]:
    n = F.length(match)
    marks = sum(F.when(F.contains(match, F.lit(x)), 1).otherwise(0) for x in (" ", ".", "-", "("))
    return {
        "size": F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3),
        "marks": F.least(marks, F.lit(3)),
        "run": F.when(match.rlike("[0-9]{10}"), 3).when(match.rlike("[0-9]{5}"), 2).when(match.rlike("[0-9]"), 1).otherwise(0),
        "grouped": F.when(match.rlike(GROUPED[kind]), 1).otherwise(0),
    }


def _touch(text: Column, start: Column, end: Column) -> Column:
    left, right = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(""), F.substring(text, end + 1, F.lit(1))
    return F.when(left.rlike(r"[\p{L}\p{N}]") | right.rlike(r"[\p{L}\p{N}]"), -1).otherwise(1)


def candidates(text: Column) -> Column:
    """An array of (kind, start, end, base, the votes, the features); kind is a place in KINDS."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(_voted(text, source, kind) for source, patterns in (("base", BASE), ("wider", WIDER)) for kind in patterns))


def _voted(text: Column, source: str, kind: str) -> Column:
    """The candidates of one pattern, with the labelers' votes and the spans' features."""
    is_base = source == "base"

    def span(x: Column) -> Column:
        valid = _valid(kind, x["match"])
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            (valid if is_base else F.lit(False)).alias("base"),
            (F.when(valid, 1).otherwise(-1) if is_base else F.lit(0)).alias("pattern"),
            _gazetteer(kind, x["match"]).alias("gazetteer"),
            _context(kind, text, x["start"], x["end"]).alias("context"),
            _touch(text, x["start"], x["end"]).alias("touch"),
            *(value.alias(name) for name, value in _features(kind, x["match"]).items()),
        )

    return F.transform(_gated(text, source, kind, lambda m: _worth(kind, m) if is_base else F.lit(True)), span)


Cell = tuple[int, tuple[int, ...], float]  # kind, votes, count
Weights = dict[tuple, float]  # of ("kind", kind), (labeler, vote) and (kind, feature, value)


def reliabilities(cells: list[Cell], rounds: int = 60) -> tuple[list[float], dict[tuple[int, int, int], float]]:
    """(posterior of each cell, P(vote | labeler, truth)) by expectation-maximisation, started from the majority of votes."""
    kinds, n = sorted({k for k, *_ in cells}), len(LABELERS)
    posterior = [1 / (1 + math.exp(-sum(v))) for _, v, _ in cells]
    table: dict[tuple[int, int, int], float] = {}
    for _ in range(rounds):
        rate = {}
        for kind in kinds:
            own = [(p, c) for p, (k, _, c) in zip(posterior, cells, strict=True) if k == kind]
            rate[kind] = (sum(p * c for p, c in own) + 1) / (sum(c for _, c in own) + 2)
        for j in range(n):
            for truth in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}  # smoothing
                mass[1 if truth else -1] += 1.0  # labelers are better than chance until shown otherwise
                for p, (_, votes, c) in zip(posterior, cells, strict=True):
                    mass[votes[j]] += c * (p if truth else 1 - p)
                for v in mass:
                    table[j, v, truth] = mass[v] / sum(mass.values())
        new = []
        for kind, votes, _ in cells:
            yes = math.log(rate[kind]) + sum(math.log(table[j, v, 1]) for j, v in enumerate(votes))
            no = math.log(1 - rate[kind]) + sum(math.log(table[j, v, 0]) for j, v in enumerate(votes))
            new.append(1 / (1 + math.exp(max(-60.0, min(60.0, no - yes)))))
        moved = max((abs(a - b) for a, b in zip(new, posterior, strict=True)), default=0.0)
        posterior = new
        if moved < 1e-9:
            break
    return posterior, table


def _active(kind: int, votes: tuple[int, ...], features: tuple[int, ...]) -> list[tuple]:
    """The weights that a candidate's score is the sum of."""
    return [("kind", kind), *((j, v) for j, v in enumerate(votes) if v), *((kind, name, x) for name, x in zip(FEATURES, features, strict=True))]


def classifier(cells: list[Cell], features: list[tuple[int, ...]], posterior: list[float], steps: int = 600, ridge: float = 1e-3) -> Weights:
    """Weights fitted to the posteriors by gradient steps on the weighted log loss."""
    names = [("kind", k) for k in range(len(KINDS))] + [(j, v) for j in range(len(LABELERS)) for v in (-1, 1)] + [(k, f, x) for k in range(len(KINDS)) for f, n in FEATURES.items() for x in range(n)]
    place = {name: i for i, name in enumerate(names)}
    on = np.zeros((len(cells), len(names)))
    for i, ((kind, votes, _), own) in enumerate(zip(cells, features, strict=True)):
        on[i, [place[x] for x in _active(kind, votes, own)]] = 1
    count, truth = np.array([c for *_, c in cells]), np.array(posterior)
    share = np.sqrt(count / (count.sum() or 1.0))  # rare patterns count for more than their share
    share = share / (share.sum() or 1.0)
    weights = np.zeros(len(names))
    for _ in range(steps if len(cells) else 0):
        q = 1 / (1 + np.exp(-np.clip(on @ weights, -60, 60)))
        weights -= 2.0 * (on.T @ (share * (q - truth)) + ridge * weights)
    return {name: float(weights[i]) for name, i in place.items()}


def fit(found: DataFrame, column: str = "_candidates") -> Weights:
    """Weights from the candidates of a whole corpus; the counts of their patterns are collected."""
    flat = found.select(F.explode(column).alias("c"))
    rows = flat.groupBy("c.kind", *(f"c.{x}" for x in (*LABELERS, *FEATURES))).count().collect()  # MOST_CELLS at most
    told = sorted((r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), float(r["count"])) for r in rows)
    cells = [(kind, votes, n) for kind, votes, _, n in told]
    return classifier(cells, [own for _, _, own, _ in told], reliabilities(cells)[0])


def accepted(column: str, weights: Weights, threshold: float) -> Column:
    """The candidates that are spans: base ones, and others that score threshold or more and overlap no base span; by kind and start."""

    def score(c: Column) -> Column:
        pick = lambda values, at: F.element_at(F.array(*(F.lit(x) for x in values)), at + 1)
        s = pick([weights["kind", k] for k in range(len(KINDS))], c["kind"])
        for j, name in enumerate(LABELERS):
            s = s + F.when(c[name] == 1, weights[j, 1]).when(c[name] == -1, weights[j, -1]).otherwise(0.0)
        for name, n in FEATURES.items():
            s = s + pick([weights[k, name, x] for k in range(len(KINDS)) for x in range(n)], c["kind"] * n + c[name])
        return s

    least = math.log(threshold / (1 - threshold))
    base = F.filter(column, lambda c: c["base"])
    more = F.filter(column, lambda c: ~c["base"] & (score(c) >= least) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return F.array_sort(F.concat(base, more))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.95) -> DataFrame:
    """A row for each document: _id and spans, an array of (kind, start, end, base, the votes and the features)."""
    found = materialize(docs.select(F.col(id_col).alias("_id"), candidates(F.col(text_col)).alias("_candidates")), "candidates")
    return found.select("_id", accepted("_candidates", fit(found), threshold).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.95) -> DataFrame:
    """docs with each span replaced by its kind in brackets, such as [EMAIL]; overlapping spans by that of the first."""
    name = "_spans"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    # Candidates are found once and written beside the rows: reading them again costs a fraction of the patterns.
    found = materialize(docs.withColumn(name, candidates(F.col(text_col))), "candidates")
    spans = found.withColumn(name, accepted(name, fit(found, name), threshold))
    text = F.col(text_col)
    by_place = F.array_sort(F.transform(name, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("end"), c["kind"].alias("kind"))))
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    put = F.aggregate(
        by_place,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, c: F.when(c["start"] < a["at"], F.struct(F.greatest(a["at"], -c["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct((-c["end"]).alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, c["start"] - a["at"]), F.element_at(marks, c["kind"] + 1))).alias("out"))
        ),
    )
    whole = F.concat(F.array_join(put["out"], ""), F.substring(text, put["at"] + 1, F.length(text)))
    return spans.withColumn(text_col, F.when(F.size(name) > 0, whole).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))
