"""Personal data by weak supervision, in Spark's own functions.

1. Base: strict patterns for e-mail addresses, IP addresses, card and phone
   numbers give spans that always stay.
2. Candidates: looser patterns find what may be personal data as well, such as
   numbers that a strict pattern ran together with their neighbours, or
   addresses written with "(at)".
3. Labelers look at each candidate and vote for a kind, for none, or abstain:
   the strict patterns, the shape of the digits, gazetteers (domains, issuers,
   country codes), the words before it, the letters around it.
4. Expectation-maximisation over the counted vote patterns (at most 6 ** 5 of
   them, however large the corpus) estimates how reliable each labeler is for
   each kind, and so how likely each kind is given the votes.
5. These soft labels train the final span classifier, naive Bayes over features
   of the span; it becomes a column expression.  Candidates that it gives a kind
   with probability ``SURE`` or more, away from base spans, are added.

A text is handled in its own row; only the pattern counts are aggregated.
"""

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from docketry.llm.frames import named

KINDS = ("email", "ip", "card", "phone")
NONE = "none"
CLASSES = (*KINDS, NONE)
SURE = 0.9
EM_STEPS = 25
#: Pseudo counts of the estimates.
SMOOTH = 0.5
#: Code points before a candidate in which labelers look for words.
BEFORE = 24

# The strict patterns.  Possessive repeats and looking behind change no match:
# a match can only begin where its run of letters begins or where the last match
# ended.  They keep the time linear and the stack flat on very long texts.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
TRIGGER = {"email": "@", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Candidates: one pattern, the first alternative that fits.
CANDIDATE = "|".join(
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++"
        r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
        r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
        r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:([ -]?)[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9])",
        r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    )
)
TOP_DOMAINS = (
    "com org net edu gov mil int info biz io co ai app dev me de fr es it nl be ch at pl pt uk ie "
    "us ca au nz jp cn in br mx ru se no fi dk cz gr tr za kr eu"
)
CONTEXT = {
    "email": "e-?mail|mail|correo|courriel",
    "phone": "phone|tel|telefon|t.l.phone|call|fax|mobile|whatsapp",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "ip": "ip|host|server|address",
    NONE: "version|isbn|issn|doi|order|invoice|id|no|token|key|password|hash|sku",
}


def located(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, match>>`` of all leftmost matches, in code points."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.transform(
        matches, lambda m, i: F.struct(F.char_length(F.get(pieces, i)).alias("gap"), m.alias("match"))
    )
    nothing = F.expr("cast(array() as array<struct<start: int, end: int, match: string>>)")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.char_length(x["match"])
        found = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(found)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    return F.aggregate(steps, begin, step, lambda done: done["out"])


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a card number is right."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d: d.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the strict pattern passes the check of its kind."""
    size = F.length(digits_of(match))
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(size.between(14, 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def _span(kind: str, x: Column) -> Column:
    return F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), x["end"].alias("end"),
        F.lit(kind).alias("kind"),
    )


def _strict_spans(text: Column, kind: str) -> Column:
    passed = F.filter(located(text, STRICT[kind]), lambda x: valid(kind, x["match"]))
    nothing = F.expr("cast(array() as array<struct<start: int, order: int, end: int, kind: string>>)")
    may = F.contains(text, F.lit(TRIGGER[kind])) if kind in TRIGGER else text.rlike("[0-9]")
    return F.when(may, F.transform(passed, lambda x: _span(kind, x))).otherwise(nothing)


def base_spans(text: Column) -> Column:
    """The strict spans of all kinds, by start and kind."""
    return F.array_sort(F.concat(*[_strict_spans(text, kind) for kind in KINDS]))


def _shape(match: Column) -> Column:
    size = F.length(digits_of(match))
    return (
        F.when(match.rlike("@|[(\\[]at"), "email")
        .when(match.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip")
        .when(match.startswith("+") & size.between(10, 15), "phone")
        .when(size.between(10, 12), "phone")
        .when(size.between(14, 19), "card")
        .otherwise("")
    )


def _strict_vote(match: Column) -> Column:
    vote = F
    for kind in KINDS:
        whole = match.rlike("^(?:" + STRICT[kind].replace(r"\G|", "") + ")$") & valid(kind, match)
        vote = vote.when(whole, kind)
    return vote.otherwise(NONE)


def _gazetteer(match: Column) -> Column:
    shape, digits = _shape(match), digits_of(match)
    domains = "|".join(TOP_DOMAINS.split())
    return (
        F.when(shape == "email", F.when(match.rlike(rf"(?i)(?:\.|dot[)\]]) ?(?:{domains})$"), "email").otherwise(NONE))
        .when(shape == "card", F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), "card").otherwise(NONE))
        .when(shape == "ip", F.when(match.rlike(r"^0|^2[4-9][0-9]"), NONE).otherwise("ip"))
        .when(
            shape == "phone",
            F.when(digits.rlike("^(?:1?[2-9][0-9]{2}[2-9]|[2-9][0-9])"), "phone").otherwise(NONE),
        )
        .otherwise("")
    )


def _context(before: Column) -> Column:
    vote = F
    for kind, words in CONTEXT.items():
        vote = vote.when(before.rlike(rf"(?i)(?<![A-Za-z])(?:{words})[\s:.#=\"']*$"), kind)
    return vote.otherwise("")


def _border(before: Column, after: Column) -> Column:
    glued = before.rlike(r"[\p{L}\p{N}_=/#\"'-]$") | after.rlike(r"^[\p{L}\p{N}_/#\"']")
    return F.when(glued, NONE).otherwise("")


LABELERS = ("strict", "shape", "gazetteer", "context", "border")
JOINTS = " .-(+@"
FEATURES = ("shape", "digits", "joint", "context", "border", "strict")


def candidates(text: Column) -> Column:
    """Candidate spans with the vote of each labeler and the features."""

    def judged(x: Column) -> Column:
        match = x["match"]
        before = F.substring(text, F.greatest(x["start"] - BEFORE, F.lit(0)) + 1, F.least(x["start"], F.lit(BEFORE)))
        after = F.substring(text, x["end"] + 1, 1)
        joint = F.concat(*[F.when(F.contains(match, F.lit(c)), c).otherwise("") for c in JOINTS])
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            _strict_vote(match).alias("strict"), _shape(match).alias("shape"),
            _gazetteer(match).alias("gazetteer"), _context(before).alias("context"),
            _border(before, after).alias("border"),
            F.least(F.length(digits_of(match)), F.lit(20)).cast("string").alias("digits"),
            joint.alias("joint"),
        )

    nothing = F.expr(
        "cast(array() as array<struct<start: int, end: int, strict: string, shape: string, gazetteer: string,"
        " context: string, border: string, digits: string, joint: string>>)"
    )
    return F.when(
        text.rlike("[0-9]{3}|@|[(\\[]at"), F.transform(located(text, CANDIDATE), judged)
    ).otherwise(nothing)


def estimate(patterns: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], list[float]]:
    """Probability of each class for each vote pattern, by expectation-maximisation.

    Starts from the share of votes; every labeler has, for each class, a
    distribution over its votes, abstaining included.
    """
    soft = {}
    for votes in patterns:
        share = [SMOOTH / len(CLASSES) + sum(v == c for v in votes) for c in CLASSES]
        soft[votes] = [s / sum(share) for s in share]
    for _ in range(EM_STEPS):
        prior = [SMOOTH + sum(n * soft[v][c] for v, n in patterns.items()) for c in range(len(CLASSES))]
        chance = []
        for labeler in range(len(LABELERS)):
            seen: dict[str, list[float]] = defaultdict(lambda: [SMOOTH] * len(CLASSES))
            for votes, n in patterns.items():
                row = seen[votes[labeler]]
                for c in range(len(CLASSES)):
                    row[c] += n * soft[votes][c]
            total = [sum(row[c] for row in seen.values()) for c in range(len(CLASSES))]
            chance.append({v: [row[c] / total[c] for c in range(len(CLASSES))] for v, row in seen.items()})
        for votes in patterns:
            logs = [
                math.log(prior[c]) + sum(math.log(chance[k][v][c]) for k, v in enumerate(votes))
                for c in range(len(CLASSES))
            ]
            soft[votes] = _normal(logs)
    return soft


def _normal(logs: list[float]) -> list[float]:
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    return [w / sum(weights) for w in weights]


def train(counted: list[tuple[tuple[str, ...], tuple[str, ...], int]]) -> dict[tuple[str, ...], str]:
    """The span classifier from (votes, features, number) of all candidates:
    the sure kind of each combination of features that has one."""
    patterns: dict[tuple[str, ...], int] = defaultdict(int)
    for votes, _, n in counted:
        patterns[votes] += n
    soft = estimate(patterns) if patterns else {}
    weight = [SMOOTH] * len(CLASSES)
    tables: list[dict[str, list[float]]] = [defaultdict(lambda: [SMOOTH] * len(CLASSES)) for _ in FEATURES]
    for votes, features, n in sorted(counted):
        for c, p in enumerate(soft[votes]):
            weight[c] += n * p
            for table, value in zip(tables, features):
                table[value][c] += n * p
    totals = [[sum(row[c] for row in t.values()) for c in range(len(CLASSES))] for t in tables]
    sure = {}
    for features in {f for _, f, _ in counted}:
        chance = _normal(
            [
                math.log(weight[c])
                + sum(math.log(t[v][c] / total[c]) for t, total, v in zip(tables, totals, features))
                for c in range(len(CLASSES))
            ]
        )
        best = max(range(len(CLASSES)), key=chance.__getitem__)
        if chance[best] >= SURE and CLASSES[best] != NONE:
            sure[features] = CLASSES[best]
    return sure


def kind_column(sure: dict[tuple[str, ...], str], x: Column) -> Column:
    """The classifier as an expression over a candidate: its kind, NULL where not sure.

    A combination of features is looked up in one constant map.  Card numbers and
    IP addresses must pass their check whatever the labelers say; a phone number
    without a country code needs a word for it in front, an address without a
    plain ``@`` the brackets or such a word.
    """
    table = F.from_json(F.lit(json.dumps({"|".join(k): v for k, v in sorted(sure.items())})), "map<string,string>")
    kind = F.try_element_at(table, F.concat_ws("|", *[x[f] for f in FEATURES]))
    hidden = (kind == "email") & (F.contains(x["joint"], F.lit("(")) | (x["context"] == "email"))
    named_phone = (kind == "phone") & (x["context"] == "phone")
    return F.when((x["strict"] == kind) | hidden | named_phone, kind)


def count_patterns(docs: DataFrame, text: str) -> list[tuple[tuple[str, ...], tuple[str, ...], int]]:
    """How often each combination of votes and features is there.

    Votes and features have fixed, small sets of values, so the list is bounded.
    """
    columns = list(dict.fromkeys((*LABELERS, *FEATURES)))
    rows = (
        docs.select(F.explode(candidates(F.coalesce(named(text).cast("string"), F.lit("")))).alias("x"))
        .groupBy(*[F.col(f"x.{c}").alias(c) for c in columns])
        .count()
        .collect()
    )
    return [(tuple(r[c] for c in LABELERS), tuple(r[c] for c in FEATURES), r["count"]) for r in rows]


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of
    ``struct<start, order, end, kind>`` by start and kind; ``spans`` holds the
    base spans and the ones added.

    Positions are code points, the end excluded.  NULL and empty texts have no
    spans.  Base spans of different kinds may overlap; an added span overlaps
    none.  Labelers are weighed over all rows of ``docs``, so a repeated row
    counts as often as it is there.  Columns of the input with these names are
    replaced; every row comes back once.
    """
    sure = train(count_patterns(docs, text))
    kept = [named(c) for c in docs.columns if c.lower() not in ("base", "spans")]
    whole = F.coalesce(named(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("_row"), whole.alias("_text"))
    rows = rows.withColumn("base", base_spans(F.col("_text")))
    if not sure:
        return rows.select("_row.*", "base", F.col("base").alias("spans"))
    rows = rows.withColumn("_found", candidates(F.col("_text")))

    def free(x: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    new = F.transform(F.filter("_found", free), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind_column(sure, x).alias("kind")))
    new = F.transform(
        F.filter(new, lambda x: x["kind"].isNotNull()),
        lambda x: F.struct(
            x["start"].alias("start"),
            (F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]) - 1).cast("int").alias("order"),
            x["end"].alias("end"), x["kind"].alias("kind"),
        ),
    )
    return rows.select("_row.*", "base", F.array_sort(F.concat("base", new)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, separated by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, as ``<KIND>``."""

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        part = F.concat(done["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        end = F.greatest(done["at"], s["end"])
        return F.struct(end.alias("at"), F.when(s["start"] >= done["at"], part).otherwise(done["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans, begin, step,
        lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))),
    )
