"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from strict patterns (the base spans, always kept) and from looser ones: e-mail
addresses written out with "at" and "dot", national phone numbers, card-shaped numbers that fail
the checksum and addresses with a part over 255. Four labelers vote -1, 0 or 1 on every candidate:
its pattern, a gazetteer, the words before it, and a validity rule. Candidates are counted by
kind and votes - at most 4 * 3^4 rows, however large the corpus - and expectation-maximisation on
those counts estimates each labeler's reliability and every combination's posterior. The
posteriors train a logistic span classifier on votes, kind and length, whose weights become one
expression; a candidate outside the base stays when its score reaches THRESHOLD.

Offsets are code points, ends exclusive. Within a kind, matches are leftmost and do not overlap; a
loose candidate that overlaps a base span is dropped.

Edge cases: null text counts as empty and gives no spans; a null doc_id and repeated rows are
scored like any other; an empty table gives no rows and default weights; other columns pass
through redact() and are ignored elsewhere.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
CONTEXT = 32
# Patterns of candidates. Possessive forms of the plain ones, so that long runs
# of matching characters take linear time and no recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+ ?[(\[] ?at ?[)\]] ?[A-Z0-9-]{1,63}+(?: ?[(\[] ?dot ?[)\]] ?[A-Z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9+(.-])(?<!\+[0-9] )(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9-])",
}
# A text without this cannot match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
GAZETTEER = {
    "email": r"(?i)\.\)?\]? ?(com|org|net|edu|gov|info|io|de|fr|es|uk|it|eu|ch|at)$|dot ?[)\]] ?(com|org|net|edu)$",
    "ip": r"^(?!0+\.|127\.|22[4-9]\.|2[3-5][0-9]\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|35|6011|65)",
    "phone": r"^(\+[1-9]|\(?[2-9][0-9]{2})",
}
CONTEXT_FOR = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach|correo|courriel)\b",
    "ip": r"(?i)\b(ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(phone|call|tel|mobile|fax|telefon|telefono|contact)\b",
}
CONTEXT_AGAINST = r"(?i)\b(version|license|isbn|issn|section|release|invoice|order|serial|build)\b[^.]{0,12}$"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
LABELERS = ("pattern", "gazetteer", "context", "validity")


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text, before) of all matches; positions are sums of gap and match lengths."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.when(
        text.rlike(pattern),
        F.aggregate(
            F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("n"), F.substring(g, -CONTEXT, CONTEXT).alias("before"))),
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string,before:string>>)").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["n"] + F.length(x["m"])).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + x["n"]).alias("start"), (acc["at"] + x["n"] + F.length(x["m"])).alias("end"), x["m"].alias("text"), x["before"].alias("before"))).alias("out"),
            ),
            lambda acc: acc["out"],
        ),
    ).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,text:string,before:string>>)"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, -1 * i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    digits = _digits(text)
    if kind == "ip":
        return text.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _possible(kind: str, text: Column) -> Column:
    """Whether a match that fails the base rule is still a candidate."""
    if kind == "ip":
        return text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    if kind == "card":
        return F.length(_digits(text)).between(15, 16)
    return F.lit(False)


def _votes(kind: str, strict: bool, x: Column) -> list[Column]:
    sign = lambda yes: F.when(yes, 1).otherwise(-1)
    return [
        F.lit(1 if strict else 0).alias("pattern"),
        sign(x["text"].rlike(GAZETTEER[kind])).alias("gazetteer"),
        F.when(x["before"].rlike(CONTEXT_AGAINST), -1).when(x["before"].rlike(CONTEXT_FOR[kind]), 1).otherwise(0).alias("context"),
        sign(_valid(kind, x["text"])).alias("validity"),
    ]


def _made(column: str, rank: int, kind: str, strict: bool) -> Column:
    """The matches in `column` that are spans or candidates of this kind."""

    def made(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"),
            F.lit(rank).alias("rank"),
            x["end"].alias("end"),
            (_valid(kind, x["text"]) if strict else F.lit(False)).alias("base"),
            F.least(F.length(x["text"]), F.lit(32)).alias("size"),
            F.struct(*_votes(kind, strict, x)).alias("votes"),
        )

    kept = F.filter(column, lambda x: _valid(kind, x["text"]) | _possible(kind, x["text"])) if strict else F.col(column)
    return F.transform(kept, made)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `candidates`: array of (start, rank, end, base, size, votes), in order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = []
    out = docs.withColumn("_text", whole)
    for kind in KINDS:
        found = F.when(F.contains("_text", F.lit(NEEDS[kind])) if kind == "email" else F.col("_text").rlike(NEEDS[kind]), _matches(F.col("_text"), BASE[kind]))
        out = out.withColumn(f"_strict_{kind}", F.coalesce(found, F.expr("cast(array() as array<struct<start:int,end:int,text:string,before:string>>)")))
        if kind in LOOSE:
            out = out.withColumn(f"_loose_{kind}", _matches(F.col("_text"), LOOSE[kind]))
    for rank, kind in enumerate(KINDS):
        for strict, column in ((True, f"_strict_{kind}"), (False, f"_loose_{kind}")):
            if not strict and kind not in LOOSE:
                continue

            parts.append(_made(column, rank, kind, strict))
    out = out.withColumn("_all", F.array_sort(F.concat(*parts)))
    out = out.withColumn("_base", F.filter("_all", lambda x: x["base"]))
    apart = F.filter("_all", lambda x: x["base"] | ~F.exists("_base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return out.withColumn("candidates", apart).drop("_text", "_all", "_base", *[f"_strict_{k}" for k in KINDS], *[f"_loose_{k}" for k in LOOSE])


def _features(kind: str, votes: tuple[int, ...], size: int) -> dict[str, float]:
    out = {f"kind:{kind}": 1.0, "length": size / 32}
    for name, vote in zip(LABELERS, votes, strict=True):
        out[f"{name}:+"], out[f"{name}:-"] = float(vote > 0), float(vote < 0)
    return out


def fit(found: DataFrame, rounds: int = 30) -> dict[str, float]:
    """Weights of the span classifier from all candidates of `found`."""
    one = F.explode("candidates").alias("c")
    counts = (
        found.select(one)
        .groupBy("c.rank", *[F.col(f"c.votes.{n}").alias(n) for n in LABELERS], "c.size")
        .count()
        .collect()  # one row for each combination of kind, votes and size: 4 * 3^4 * 32 at most
    )
    table = sorted((KINDS[r[0]], tuple(r[1:5]), r[5], r[6]) for r in counts)  # sums of floats in one order
    posterior: dict[tuple, float] = {}
    for kind in KINDS:
        rows = [(v, n) for k, v, _, n in table if k == kind]
        total = sum(n for _, n in rows)
        if not total:
            continue
        prior = 0.7
        # Starting reliabilities: a labeler is right more often than not and may abstain.
        says = [{z: {v: (0.6 if v == z else 0.1 if v == -z else 0.3) for v in (-1, 0, 1)} for z in (-1, 1)} for _ in LABELERS]
        for _ in range(rounds):
            weights: list[tuple[float, float]] = []
            for votes, n in rows:
                yes = prior * math.prod(s[1][v] for s, v in zip(says, votes, strict=True))
                no = (1 - prior) * math.prod(s[-1][v] for s, v in zip(says, votes, strict=True))
                weights.append((n * yes / (yes + no), n * no / (yes + no)))
            prior = (sum(w for w, _ in weights) + 7) / (total + 10)
            for i, s in enumerate(says):
                for z, part in ((1, 0), (-1, 1)):
                    mass = {v: 3.0 * (0.6 if v == z else 0.1 if v == -z else 0.3) for v in (-1, 0, 1)}
                    for (votes, _), w in zip(rows, weights, strict=True):
                        mass[votes[i]] += w[part]
                    s[z] = {v: m / sum(mass.values()) for v, m in mass.items()}
        for votes, _ in rows:
            yes = prior * math.prod(s[1][v] for s, v in zip(says, votes, strict=True))
            no = (1 - prior) * math.prod(s[-1][v] for s, v in zip(says, votes, strict=True))
            posterior[kind, votes] = yes / (yes + no)
    # Every strict, valid combination is a positive by definition of the base.
    rows = [(_features(k, v, size), 1.0 if v[0] == v[3] == 1 else posterior[k, v], n) for k, v, size, n in table]
    rows += [(_features(k, (1, 1, 1, 1), 16), 1.0, 1) for k in KINDS] + [(_features(k, (0, -1, -1, -1), 16), 0.0, 1) for k in KINDS]
    weights = dict.fromkeys(rows[0][0], 0.0) | {f"kind:{k}": 0.0 for k in KINDS}
    total = sum(n for _, _, n in rows)
    for step in range(300):
        slope = {k: 0.002 * w for k, w in weights.items()}
        for x, y, n in rows:
            z = sum(weights[k] * v for k, v in x.items())
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            for k, v in x.items():
                slope[k] += miss * v * n / total
        for k in weights:
            weights[k] -= 4 / (1 + step / 100) * slope[k]
    return weights


def score(x: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability for one candidate."""
    terms = [weights["length"] * x["size"] / 32]
    terms += [F.when(x["rank"] == i, float(weights[f"kind:{k}"])).otherwise(0.0) for i, k in enumerate(KINDS)]
    for name in LABELERS:
        vote = x["votes"][name]
        terms.append(F.when(vote > 0, float(weights[f"{name}:+"])).when(vote < 0, float(weights[f"{name}:-"])).otherwise(0.0))
    return 1 / (1 + F.exp(-1 * reduce(lambda a, b: a + b, terms)))


def spans(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """found with `spans`: array of (start, rank, end, base, kind) that are base or score enough."""
    names = F.array(*map(F.lit, KINDS))
    kept = F.filter("candidates", lambda x: x["base"] | (score(x, weights) >= THRESHOLD))
    return found.withColumn(
        "spans",
        F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["base"].alias("base"), F.element_at(names, x["rank"] + 1).alias("kind"))),
    ).drop("candidates")


def listing(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by its kind in brackets; overlapping spans go as one, named after the first."""
    # The input's columns travel in one struct, so that none has the name of a working column.
    found = candidates(docs.select("text", F.struct(*docs.columns).alias("row")))
    out = spans(found, fit(found))
    done = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, x: F.when(
            x["start"] >= acc["at"],
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(F.substring("text", acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("text", acc["at"] + 1, F.length("text"))),
    )
    text = F.when(F.size("spans") > 0, done).otherwise(F.col("text"))
    return out.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def _count(rank: int) -> Column:
    return F.size(F.filter("_base", lambda x: x["rank"] == rank)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest and all spans as text, one row per document."""
    found = staged(candidates(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "candidates"), "pii")
    out = spans(found, fit(found)).withColumn("_base", F.filter("spans", lambda x: x["base"]))
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(listing(F.col("_base")), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
