"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

All of it is DataFrame functions. Regular expressions propose candidates in whole texts: the base forms and wider ones. Five
labelers (form, checksum, gazetteer, context, neighbours) give each candidate a vote of -1, 0 or 1. What training needs of the
corpus is how often each pattern of votes and shape comes up for each kind, over all candidates of all texts: a table whose
size has a bound (kinds x patterns), counted with partial sums. On it, in one row for each kind, a fold runs
expectation-maximisation (how often is each labeler right) and another one fits a logistic regression of spans to the
probabilities found. Base spans are anchors: those that hold are personal data, those that fail their check are none.

Expressions are written so that a search in a long text takes linear time: a run that can't match is left as a whole. Places
come from running sums over the matches of a text, in parts of PART, so that a text with very many matches is no square.

Odd rows: a null or empty text has no spans; ids may be null or repeated, each row stands for itself; columns of other names
don't matter; an empty table gives no rows and no model. A wider span that overlaps a base span is dropped; spans of one kind
never overlap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "name")
PART = 512
ROUNDS, STEPS, RIDGE, LEAST = 30, 150, 0.1, 0.5
#: Counts that speak for each labeler before any are made: votes of 1 and -1 on personal data, votes of 1 and -1 on other spans.
TRUST = {"form": (9, 1, 5, 5), "checksum": (1000, 1, 20, 180), "gazetteer": (7, 3, 3, 7), "context": (16, 1, 4, 30), "neighbours": (19, 1, 12, 8)}

# Words that labelers know.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
GIVEN = """Alice Andrew Anna Anne Antonio Barbara Carlos Carmen Charles Charlotte Christine Christopher Claire Daniel David Elizabeth Emily Emma
Francisco François Frank George Günther Hans Heinrich Isabel James Jane Jean Jennifer Jessica Johannes John Jonathan Joseph José Juan Julia Julie Karen Karl
Klaus Laura Linda Lisa Louis Lucas Luis Manuel Margaret Maria Marie Mark Martin Mary Matthew Michael Michel Miguel Nathalie Nicole Olivia Patricia Paul
Pedro Peter Philippe Pierre Rachel Richard Robert Rosa Sandra Sarah Sophie Stefan Stephanie Steven Susan Thomas Ursula Wilhelm William Wolfgang""".split()
TOPS = "com org net edu gov mil int info io biz de fr es uk us eu ca ch at it nl be pl se no dk pt mx br ar au nz jp cn in example test".split()
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
NEAR = {
    "email": "mail|contact|kontakt|write to|reach|correo|courriel", "ip": "ip|host|server|address|addr|adresse|client|login", "card": "card|visa|credit|debit|karte|carte|tarjeta|payment", "phone": "phone|call|tel|mobile|fax|contact|cell|handy|llame",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer", "ssn": "ssn|social security|tax id", "name": "name|dear|signed|contact|patient|regards|sincerely|nom|nombre",
}
AWAY = "version|release|build|invoice|order|isbn|issn|total|page|item|serial|commit|hash|digest|model|chapter|section|figure|sku|doi|token|checksum"

_WORD, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The base forms, as the contract has them: a run of the first class is left as a whole, or goes on where the last match ended.
BASE_FORMS = {
    "email": rf"(?:\G|(?<![{_WORD}]))[{_WORD}]++@[{_DOMAIN}]++(?:\.[{_DOMAIN}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _listed(words: list[str]) -> str:
    """An expression for any of the words, by their first letters."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (w[0], -len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by.items())


#: Wider forms, each tried at few places of a text and for a bounded length.
WIDER_FORMS = {
    "email": rf"(?<![{_WORD}])[{_WORD}]{{1,64}}+\x20?[(\[{{]at[)\]}}]\x20?[{_DOMAIN}]{{1,63}}+(?:\x20?(?:[(\[{{]dot[)\]}}]|\.)\x20?[{_DOMAIN}]{{1,63}}+){{1,5}}",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_][0-9]{3,6}){2,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+/-])(?<![0-9][\x20._])(?:00?[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z/-]|[\x20._][0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_listed(TITLES)})\.?\x20\p{{Lu}}\p{{L}}{{1,30}}(?:\x20\p{{Lu}}\p{{L}}{{1,30}})?|(?:{_listed(GIVEN)})\x20\p{{Lu}}\p{{L}}{{1,30}})(?!\p{{L}})",
}
#: What a text must hold for a search to be worth it.
SIGNS = {"email": "@", "phone": "+"}
WIDER_SIGNS = {"email": r"[(\[{]at[)\]}]", "ip": ":", "card": "[0-9]{4}[./_][0-9]{3}", "phone": "[0-9)][ ./-][0-9]{3}", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}

_SPAN = "struct<start:long,end:long,value:string,before:string,after:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """What ``join`` makes of each value of an array of longs and all before it. Parts are folded by themselves, then joined with
    what came before them, so that appending never copies more than PART values."""
    none, first = F.expr("cast(array() as array<long>)"), F.lit(zero).cast("long")

    def fold(a: Column) -> Column:
        step = lambda s, x: let(join(s["v"], x), lambda v: F.struct(v.alias("v"), F.array_append(s["all"], v).alias("all")))
        return F.aggregate(a, F.struct(first.alias("v"), none.alias("all")), step)["all"]

    def whole(parts: Column) -> Column:
        before = F.concat(F.array(first), fold(F.transform(parts, lambda x: F.element_at(x, -1))))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: join(F.get(b, i), x)))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda i: fold(F.slice(v, i * PART + 1, F.lit(PART))))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), whole)).otherwise(none))


def matches(pattern: str, sign: Column | None = None) -> Column:
    """The matches of a pattern in ``_text`` from left to right, none overlapping, with their places in
    code points (end exclusive) and up to 48 and 16 code points of what stands between them and their neighbours."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    hit = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))

    def places(m: Column, p: Column, e: Column) -> Column:
        return F.transform(m, lambda v, i: F.struct((F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("value"), F.right(F.get(p, i), F.lit(48)).alias("before"), F.left(F.get(p, i + 1), F.lit(16)).alias("after")))

    def between(m: Column, p: Column) -> Column:
        sizes = F.transform(m, lambda v, i: (F.length(v) + F.length(F.get(p, i))).cast("long"))
        return let(running(sizes, lambda a, b: a + b, 0), lambda e: places(m, p, e))

    # one expression, with each part bound: a column of its own would be put into the lambdas and worked out for each match
    found = let(hit, lambda m: F.when(F.size(m) > 0, let(F.split("_text", pattern, -1), lambda p: between(m, p))).otherwise(none))
    return found if sign is None else F.when(sign, found).otherwise(none)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def holds(kind: str, v: Column) -> Column:
    """Whether a match of a base form passes its check."""
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(v)).between(12, 19) & _luhn(digits(v))
    if kind == "phone":
        return F.length(digits(v)).between(9, 15)
    return F.lit(True)


def _holds(kind: str, s: Column) -> Column:
    return holds(kind, s["value"])


def _held(kind: str, number: int) -> Column:
    """Base spans of a kind as (start, kind, end)."""
    return F.transform(F.filter(f"_{kind}", lambda s: holds(kind, s["value"])), lambda s: _place(number, s))


def _place(kind: int, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _sign(yes: Column, no: Column | None = None) -> Column:
    """A vote: 1 if ``yes``, else -1 if ``no`` (or, without it, always), else 0."""
    out = F.when(yes, 1)
    return out.otherwise(-1) if no is None else out.when(no, -1).otherwise(0)


def _mod97(v: Column) -> Column:
    v = F.regexp_replace(v, " ", "")
    moved = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def votes(kind: str, s: Column) -> list[Column]:
    """The labelers' votes on a span: form, checksum, gazetteer, context, neighbours."""
    v = s["value"]
    number, last = digits(v), F.regexp_extract(v, r"([A-Za-z0-9-]+)$", 1)
    zero = F.lit(0)
    form = {
        "email": _sign(v.rlike(r"@|[(\[{]dot"), ~last.rlike("[A-Za-z]")), "ip": _sign(v.rlike(r"\.|::|(?:[^:]+:){7}")), "card": _sign(v.rlike(r"^[0-9]{13,16}$|^[0-9]{4}([^0-9]?)(?:[0-9]{4}\1){2}[0-9]{1,7}$")),
        "phone": _sign(v.rlike(r"^\+|\("), v.rlike(r"\..*\..*\.|^[1-9][0-9]{3}")), "iban": _sign(F.length(F.regexp_replace(v, " ", "")).between(15, 34)), "ssn": F.lit(1), "name": _sign(v.rlike(f"^(?:{_listed(TITLES)})\\b"), F.lit(False)),
    }[kind]
    check = {
        "email": _sign(last.rlike("^[A-Za-z]{2,}$")), "ip": F.when(v.contains("."), _sign(holds("ip", v))).otherwise(0), "card": _sign(F.length(number).between(12, 19) & _luhn(number)), "phone": _sign(F.lit(False), ~F.length(number).between(9, 15)),
        "iban": _sign(_mod97(v) == 1), "ssn": _sign(~v.rlike("^(?:000|666|9)|-00-|-0000$")), "name": zero,
    }[kind]
    lengths = F.create_map(*(F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv))
    gazetteer = {
        "email": _sign(F.lower(last).isin(*TOPS), F.lit(False)), "ip": _sign(F.lit(False), v.rlike(r"^(?:0|127|255)\.")), "card": _sign(number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|62|65)")),
        "phone": _sign(F.when(v.startswith("+"), number.rlike("^[1-9]")).otherwise(number.rlike("^(?:0[1-9]|00[1-9]|[2-9][0-9]{2}[2-9])"))), "iban": _sign(F.coalesce(F.try_element_at(lengths, F.left(v, F.lit(2))) == F.length(F.regexp_replace(v, " ", "")), F.lit(False))),
        "ssn": zero, "name": _sign(v.rlike(rf"(?:^|\x20)(?:{_listed(GIVEN)})\x20"), F.lit(False)),
    }[kind]
    context = _sign(F.lower(s["before"]).rlike(rf"\b(?:{NEAR[kind]})\b"), F.lower(s["before"]).rlike(rf"\b(?:{AWAY})\b[^.!?]*$"))
    neighbours = _sign(s["before"].rlike(r"[\p{L}0-9_/=#&-]$") | s["after"].rlike(r"^[\p{L}0-9_/=#&]"), F.lit(True)) * -1
    return [form, check, gazetteer, context, neighbours]


#: Numbers of the features of a span: one for all, three for each labeler, three for length, three for separators.
N_LABELERS = len(TRUST)
SIZE = 1 + 3 * N_LABELERS + 6


def judged(kind: str, spans: Column, anchor: Callable[[Column], Column]) -> Column:
    """Spans as (start, end, kind, anchor, votes, features)."""

    def one(s: Column) -> Column:
        made = F.array(*(v.cast("int") for v in votes(kind, s)))
        n, apart = F.length(s["value"]), F.length(F.regexp_replace(s["value"], "[\\p{L}0-9]", ""))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), anchor(s).cast("int").alias("anchor"), made.alias("votes"),
                        F.array(F.when(n <= 12, 0).when(n <= 20, 1).otherwise(2), F.when(apart == 0, 0).when(apart <= 2, 1).otherwise(2)).alias("shape"))

    return F.transform(spans, one)


def features(votes: Column, shape: Column) -> Column:
    """Numbers from 1 of the features that a span has."""
    seen = F.transform(votes, lambda v, j: 2 + 3 * j + v + 1)
    return F.concat(F.array(F.lit(1)), seen, F.transform(shape, lambda v, j: F.lit(2 + 3 * N_LABELERS) + 3 * j + v))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _sum_at(weights: Column, at: Column) -> Column:
    return F.aggregate(at, F.lit(0.0), lambda a, i: a + F.element_at(weights, i))


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def _plus(sums: Column, hot: Column, by: Column) -> Column:
    """sums with ``by`` added where ``hot`` is 1."""
    return F.zip_with(sums, hot, lambda s, h: s + h * by)


def _hot(at: Column, n: int) -> Column:
    """n values, 1 at the numbers that ``at`` lists and 0 elsewhere."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(F.array_contains(at, i), 1.0).otherwise(0.0))


def _belief(p: Column, odds: Column) -> Column:
    """The probability that a pattern's spans are personal data: known of anchors, else by the labelers' odds."""
    return F.when(p["anchor"].isNotNull(), p["anchor"].cast("double")).otherwise(_logistic(_sum_at(odds, p["at"])))


#: Odds: three for each labeler, then those of any span.
ODDS = 3 * N_LABELERS + 1


def reliabilities(patterns: Column) -> Column:
    """Expectation-maximisation over ``patterns`` (at: numbers of the votes and ODDS, anchor, n): for each labeler the log odds that
    a vote of -1, 0 or 1 gives, and last those before any vote. Before any count, those of TRUST speak for
    each labeler."""

    def counted(rows: Column, odds: Column) -> Column:
        def add(sums: Column, p: Column) -> Column:
            return let(_belief(p, odds), lambda q: F.struct(_plus(sums["yes"], p["hot"], p["n"] * q).alias("yes"), _plus(sums["no"], p["hot"], p["n"] * (1 - q)).alias("no")))

        return F.aggregate(rows, nothing, add)

    def to_odds(sums: Column) -> Column:
        def each(i: Column) -> Column:
            other, held = F.when(F.pmod(i, F.lit(3)) == 1, i + 2).otherwise(i - 2), lambda of, k: F.element_at(of, k.cast("int"))
            share = lambda of, known: F.log((held(of, i) + held(known, i)) / (held(of, i) + held(of, other) + held(known, i) + held(known, other)))
            return F.when(F.pmod(i, F.lit(3)) == 2, 0.0).otherwise(share(sums["yes"], known_yes) - share(sums["no"], known_no))  # who abstains says nothing

        before = F.log((F.element_at(sums["yes"], ODDS) + 2) / (F.element_at(sums["no"], ODDS) + 2))
        return F.concat(F.transform(F.sequence(F.lit(1), F.lit(ODDS - 1)), each), F.array(before))

    known_yes, known_no = (F.array(*(F.lit(float(x)) for t in TRUST.values() for x in (t[i + 1], 0, t[i]))) for i in (0, 2))
    nothing = F.struct(_zeros(ODDS).alias("yes"), _zeros(ODDS).alias("no"))
    ready = F.transform(patterns, lambda p: F.struct(p["at"].alias("at"), p["anchor"].alias("anchor"), p["n"].cast("double").alias("n"), _hot(p["at"], ODDS).alias("hot")))
    return let(ready, lambda rows: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), let(nothing, to_odds), lambda odds, _: let(counted(rows, odds), to_odds)))


def fitted(patterns: Column, odds: Column) -> Column:
    """Weights of a logistic regression of spans, fitted to what the labelers' odds say of each of ``patterns`` (features, at,
    anchor, n). A step moves all weights at once, each by its slope over a bound of its curvature, so that the fit never gets worse."""
    aimed = F.transform(patterns, lambda p: F.struct(p["features"].alias("x"), _hot(p["features"], SIZE).alias("hot"), p["n"].cast("double").alias("n"), _belief(p, odds).alias("q")))

    def step(w: Column, mass: Column, rows: Column) -> Column:
        slope = F.aggregate(rows, _zeros(SIZE), lambda a, p: _plus(a, p["hot"], p["n"] * (p["q"] - _logistic(_sum_at(w, p["x"])))))
        return let(slope, lambda g: F.transform(w, lambda x, i: x + (F.get(g, i) - RIDGE * x) / (F.get(mass, i) * (N_LABELERS + 3) / 4 + RIDGE)))

    def fit(rows: Column) -> Column:
        mass = F.aggregate(rows, _zeros(SIZE), lambda a, p: _plus(a, p["hot"], p["n"]))
        return let(mass, lambda m: F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _zeros(SIZE), lambda w, _: step(w, m, rows)))

    return let(aimed, fit)


def model(candidates: DataFrame) -> dict[int, list[float]]:
    """Weights of each kind that has candidates, from ``candidates`` (kind, anchor, votes, shape): one row for each span of all texts."""
    counted = candidates.groupBy("kind", "anchor", "votes", "shape").agg(F.count(F.lit(1)).alias("n"))
    at = F.concat(F.transform("votes", lambda v, j: 3 * j + v + 2), F.array(F.lit(ODDS)))
    one = F.struct("votes", "shape", "anchor", "n", at.alias("at"), features(F.col("votes"), F.col("shape")).alias("features"))
    rows = counted.groupBy("kind").agg(F.array_sort(F.collect_list(one)).alias("p"))  # at most 243 x 9 x 3 patterns
    weights = let(F.col("p"), lambda p: let(reliabilities(p), lambda odds: fitted(p, odds)))
    return {r.kind: list(r.w) for r in rows.select("kind", weights.alias("w")).collect()}


def candidates_of(docs: DataFrame) -> DataFrame:
    """docs' ids with _base (start, kind, end: spans that hold) and _all (judged spans of both forms)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    text = F.col("_text")
    signs = {"ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]")} | {k: text.contains(x) for k, x in SIGNS.items()}
    narrow = [matches(form, signs[kind]).alias(f"_{kind}") for kind, form in BASE_FORMS.items()]
    wide = [matches(form, text.rlike(WIDER_SIGNS[kind]) if kind in WIDER_SIGNS else None).alias(f"_wide_{kind}") for kind, form in WIDER_FORMS.items()]
    df = df.select("doc_id", *narrow, *wide)
    # a run of fewer digits than a card, an address or a number of a phone has is no example of anything
    long_enough = lambda s: F.length(digits(s["value"])) >= 9
    base, seen = [], []
    for i, kind in enumerate(BASE):
        base.append(_held(kind, i))
        spans = F.filter(f"_{kind}", long_enough) if kind in ("card", "phone") else F.col(f"_{kind}")
        seen.append(judged(kind, spans, partial(_holds, kind)))
    seen += [judged(kind, F.col(f"_wide_{kind}"), lambda s: F.lit(None)) for kind in KINDS]
    return df.select("doc_id", F.array_sort(F.concat(*base)).alias("_base"), F.concat(*seen).alias("_all"))


def _apart(base: Column, more: Column) -> Column:
    """Spans (start, kind, end) of ``more`` that overlap none of ``base``."""
    tag = lambda a, own: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(own).alias("base")))
    every = F.array_sort(F.concat(tag(base, True), tag(more, False)))
    far = -(1 << 60)

    def kept(a: Column) -> Column:
        upto = running(F.transform(a, lambda s: F.when(s["base"], s["end"]).otherwise(far).cast("long")), F.greatest, far)
        later = F.reverse(running(F.reverse(F.transform(a, lambda s: F.when(s["base"], -s["start"]).otherwise(far).cast("long"))), F.greatest, far))
        alone = lambda u, l: F.filter(a, lambda s, i: ~s["base"] & (F.get(u, i) <= s["start"]) & (-F.get(l, i) >= s["end"]))  # noqa: E731, E741
        return F.transform(let(upto, lambda u: let(later, lambda l: alone(u, l))), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return let(every, kept)


def _said(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of (doc_id, text); a wider span counts if its probability is ``least`` or more."""
    found = stash(candidates_of(docs), "personal-data")
    weights = model(found.select(F.explode("_all").alias("s")).select("s.kind", "s.anchor", "s.votes", "s.shape"))
    none = F.expr("cast(array() as array<struct<start:long,kind:int,end:long>>)")
    if weights:
        known = F.create_map(*(c for k, w in sorted(weights.items()) for c in (F.lit(k), F.array(*(F.lit(float(x)) for x in w)))))
        sure = lambda s: s["anchor"].isNull() & (_logistic(_sum_at(F.element_at(known, s["kind"]), features(s["votes"], s["shape"]))) >= least)
        added = F.when(F.exists("_all", lambda s: s["anchor"].isNull()), F.transform(F.filter("_all", sure), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).otherwise(none)
    else:
        added = none
    out = found.withColumn("_more", added)
    spans = F.when(F.size("_more") > 0, F.array_sort(F.concat("_base", _apart(F.col("_base"), F.col("_more"))))).otherwise(F.col("_base"))
    count = lambda i: F.size(F.filter("_base", lambda s: s["kind"] == i)).cast("long")
    return out.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(_said(F.col("_base")), 256).alias("base_sha256"), _said(spans).alias("spans"))
