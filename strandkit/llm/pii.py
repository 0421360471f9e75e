"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans of four kinds: email, ip, card and phone.  Loose
patterns give further candidates (written-out addresses, national phone numbers,
numbers with unusual separators).  Labelers vote on every candidate: +1, -1 or 0
(no opinion).

* regex: the strict pattern holds (+1)
* checksum: digits pass or fail the check of the kind
* gazetteer: known top-level domain, issuer prefix, calling code or address range
* context: a cue word of the kind, or a cue word against it, stands before the span
* shape: separators are used as people write such data, or mixed at random

Expectation-maximisation estimates from the table of vote patterns how often each
labeler is right when it votes; its posteriors train a logistic regression, which
decides on candidates that are not base spans.  Base spans always stay.  A candidate
that overlaps a base span is left out.

The vote-pattern table has at most 4 * 3^5 rows whatever the corpus.  Texts are
read whole; a null counts as empty.  Empty tables, repeated rows and further columns
need no care: everything but the pattern counts happens inside one row.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkit.session import reliable_checkpoint, ship_package

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "checksum", "gazetteer", "context", "shape")
EM_ROUNDS = 30
START_ACCURACY = 0.8
ACCURACY_RANGE = (0.55, 0.99)
MIN_PROBABILITY = 0.8
CONTEXT_CHARS = 40

# The patterns of the contract.  Possessive quantifiers and the look-behinds change no match:
# a local part or number that fails at its first character fails at all later ones.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![\w.%+-])[a-z0-9][a-z0-9._%+-]{0,63}+\x20?(?:\(at\)|\[at\]|\{at\}|<at>|\x20at\x20|@)\x20?[a-z0-9-]{1,63}+"
             r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\x20dot\x20|\.)\x20?[a-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\])\x20?[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![A-Za-z0-9])[0-9]{4}+(?:[._/][0-9]{4}+){2}[._/][0-9]{1,7}+(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+._-])(?:\([0-9]{2,5}\)|00[0-9]{1,3}|0[0-9]{1,5}|[0-9]{3})(?:[\x20./-]{1,2}[0-9]{2,8}){1,5}(?![A-Za-z0-9])",
}
# Characters without which a pattern cannot match: texts without them skip it.
NEEDS = {"email": "@", "phone": "+"}

# -- fixed values: word and number lists of the gazetteer and context labelers
TOP_DOMAINS = (
    "com org net edu gov mil int info biz io ai app dev me tv uk us ca au nz ie de fr es it nl be at ch pt pl cz dk se no fi gr hu ro ru ua "
    "tr il in cn jp kr tw hk sg br mx ar cl co za eu example test invalid"
).split()
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6(?:011|4|5)|30|38|62)"
CALLING_CODES = (
    r"^(?:1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|2[2-6][0-9]|35[0-9]|37[0-9]|38[0-9]|42[013]|"
    r"50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0256]|880|886|96[0-8]|97[0-7]|99[2-8])"
)
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel|reach|adresse?)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|client|peer|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment|account)\b",
    "phone": r"(?i)\b(?:phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|call|mobile|cell|fax|whatsapp|sms|dial|ring)\b",
}
COUNTER_CUES = {
    "email": r"(?i)\b(?:arrived|look|looked|looking|stay|meet)\b",
    "ip": r"(?i)\b(?:version|release|section|chapter|v)\b",
    "card": r"(?i)\b(?:isbn|order|invoice|serial|tracking|id|hash|key)\b",
    "phone": r"(?i)\b(?:isbn|issn|order|invoice|serial|pages?|version|date|born|id|no)\b",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a digit string passes the Luhn check."""
    n = F.length(digits)

    def term(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), term) % 10 == 0


def _octets(value: Column) -> Column:
    parts = F.split(value, "[^0-9]+")
    return F.forall(parts, lambda p: (p == "") | p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))


def _holds(kind: str, value: Column) -> Column:
    """The check that a match of the strict pattern must pass."""
    digits = _digits(value)
    return {
        "email": F.lit(True),
        "ip": _octets(value),
        "card": F.length(digits).between(12, 19) & luhn(digits),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def _located(text: Column, pattern: str) -> Column:
    """Matches with their places: array of (value, start, end), in code points.

    The pieces between the matches give the places; both functions walk the text
    with the same matcher."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<value:string,start:int,end:int>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        spot = F.struct(pair["value"].alias("value"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(spot)).alias("out"))

    pairs = F.filter(F.arrays_zip(matches.alias("value"), pieces.alias("piece")), lambda p: p["value"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _spans(text: Column, kind: str, loose: bool) -> Column:
    """Array of (kind number, start, end, base, value) of one pattern."""
    pattern = (LOOSE if loose else STRICT)[kind]
    spans = F.transform(
        _located(text, pattern),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"),
            F.lit(not loose).alias("base"), s["value"].alias("value"),
        ),
    )
    if not loose:
        spans = F.filter(spans, lambda s: _holds(kind, s["value"]))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,value:string>>")
    has = text.contains(NEEDS[kind]) & text.rlike(pattern) if kind in NEEDS and not loose else text.rlike(pattern)
    return F.when(has, spans).otherwise(empty)


def _votes(text: Column, span: Column) -> Column:
    """Votes of all labelers on a span, as an array in the order of ``LABELERS``."""
    value, kind = span["value"], span["kind"]
    digits = _digits(value)
    start = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    before = F.substr(text, start + 1, span["start"] - start)

    def per_kind(build) -> Column:
        out = F.lit(0)
        for i, name in enumerate(KINDS):
            out = F.when(kind == i, build(name)).otherwise(out)
        return out

    def sign(yes: Column, no: Column | None = None) -> Column:
        out = F.when(yes, 1)
        return (out.when(no, -1) if no is not None else out).otherwise(0)

    def checksum(name: str) -> Column:
        if name == "card":
            return sign(F.length(digits).between(12, 19) & luhn(digits), F.lit(True))
        if name == "ip":
            return sign(F.lit(False), ~_octets(value))
        if name == "phone":
            return sign(F.lit(False), ~F.length(digits).between(9, 15))
        return F.lit(0)

    def gazetteer(name: str) -> Column:
        if name == "email":
            last = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)[^A-Za-z0-9-]*$", 1))
            return sign(last.isin(TOP_DOMAINS), F.lit(True))
        if name == "card":
            return sign(digits.rlike(CARD_PREFIX), F.lit(True))
        if name == "phone":
            code = F.when(F.startswith(value, F.lit("+")), digits).when(F.startswith(digits, F.lit("00")), F.substring(digits, 3, 15))
            return sign(code.isNotNull() & code.rlike(CALLING_CODES), code.isNotNull() & ~code.rlike(CALLING_CODES))
        return sign(F.lit(False), F.startswith(digits, F.lit("0")))

    def shape(name: str) -> Column:
        if name == "email":
            return sign(value.rlike(r"(?i)@|[\(\[\{<]at[\)\]\}>]"), ~value.rlike(r"(?i)dot"))
        if name == "phone":
            marks = F.array_distinct(F.regexp_extract_all(value, F.lit(r"[\x20./-]"), F.lit(0)))
            return sign((F.size(marks) == 1) | F.startswith(value, F.lit("+")), F.size(marks) > 2)
        if name == "card":
            return sign(F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("[^0-9]"), F.lit(0)))) <= 1, F.lit(True))
        return sign(F.lit(True))

    context = per_kind(lambda name: sign(before.rlike(CUES[name]), before.rlike(COUNTER_CUES[name])))
    return F.array(sign(span["base"]), per_kind(checksum), per_kind(gazetteer), context, per_kind(shape))


def candidates(text: Column) -> Column:
    """All candidate spans with their votes: array of (start, kind, end, base, votes)."""
    strict = F.concat(*[_spans(text, kind, False) for kind in KINDS])
    loose = F.concat(*[_spans(text, kind, True) for kind in KINDS])

    def free(span: Column, base: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    # bound by a one-element array, so that the spans are found once and not for every element
    bound = F.array(F.struct(strict.alias("strict"), loose.alias("loose")))
    both = F.flatten(F.transform(bound, lambda b: F.concat(b["strict"], F.filter(b["loose"], lambda s: free(s, b["strict"])))))
    return F.transform(
        F.array_sort(both),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), _votes(text, s).alias("votes")),
    )


def vote_patterns(spans: Column, rows: DataFrame) -> DataFrame:
    """(kind, votes, n): how often each pattern of votes occurs.  Combines on the map side."""
    return rows.select(F.explode(spans).alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n"))


def estimate_accuracies(patterns: list[tuple[int, list[int], int]], rounds: int = EM_ROUNDS) -> tuple[list[float], list[float]]:
    """Expectation-maximisation over the pattern table: accuracies and posteriors.

    A labeler that votes is right with its accuracy, whatever the truth; labelers
    vote independently given the truth."""
    accuracy = [START_ACCURACY] * len(LABELERS)
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        odds = [math.log(a / (1 - a)) for a in accuracy]
        posterior = [1 / (1 + math.exp(-sum(v * o for v, o in zip(votes, odds)))) for _, votes, _ in patterns]
        for j in range(len(LABELERS)):
            right = voted = 0.0
            for p, (_, votes, n) in zip(posterior, patterns):
                if votes[j]:
                    voted += n
                    right += n * (p if votes[j] > 0 else 1 - p)
            share = (right + START_ACCURACY * 10) / (voted + 10)
            accuracy[j] = min(max(share, ACCURACY_RANGE[0]), ACCURACY_RANGE[1])
    return accuracy, posterior


class SpanClassifier:
    """Logistic regression on the votes, trained on the posteriors of the labelers."""

    def __init__(self, weights: list[float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def probability(self, span: Column) -> Column:
        score = F.lit(self.intercept)
        for i, weight in enumerate(self.weights):
            score = score + weight * span["votes"][i]
        return 1 / (1 + F.exp(-score))

    def accepts(self, span: Column) -> Column:
        return span["base"] | (self.probability(span) >= MIN_PROBABILITY)


def train(rows: DataFrame, spans: Column) -> SpanClassifier:
    """Fits on the pattern table (bounded); ``rows`` should be a written table."""
    table = sorted((r["kind"], list(r["votes"]), r["n"]) for r in vote_patterns(spans, rows).collect())
    if not table:
        return SpanClassifier([0.0] * len(LABELERS), -10.0)
    _, posterior = estimate_accuracies(table)
    spark = rows.sparkSession
    values = ", ".join(
        f"({y}d, {n * (p if y else 1 - p)!r}d, {', '.join(f'{v}d' for v in votes)})"
        for p, (_, votes, n) in zip(posterior, table) for y in (0, 1)
    )
    frame = spark.sql(f"SELECT * FROM VALUES {values} AS t(label, weight, {', '.join(LABELERS)})").coalesce(1)
    points = VectorAssembler(inputCols=list(LABELERS), outputCol="features").transform(frame)
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50, standardization=False).fit(points)
    return SpanClassifier([round(float(w), 6) for w in model.coefficients], round(float(model.intercept), 6))


def _written(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    parts = F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def find(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    ship_package(docs.sparkSession)
    whole = docs.select(F.col(ident).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = reliable_checkpoint(whole.select("doc_id", candidates(F.col("text")).alias("spans")))
    model = train(rows, F.col("spans"))
    base = F.filter("spans", lambda s: s["base"])

    def of_kind(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == i))).cast("long")

    counts = [of_kind(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.filter("spans", model.accepts)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets."""
    ship_package(docs.sparkSession)
    rows = reliable_checkpoint(docs.select(F.struct("*").alias("__row"), candidates(F.coalesce(text, F.lit(""))).alias("__spans")))
    model = train(rows, F.col("__spans"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    whole = F.col("__row")[text]
    ordered = F.array_sort(F.transform(F.filter("__spans", model.accepts), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        # a span that begins inside the one before it is covered by that one's mark as far as it goes
        begin = F.greatest(s["start"], acc["at"])
        part = F.concat(F.substr(whole, acc["at"] + 1, begin - acc["at"]), F.when(s["start"] >= acc["at"], names[s["kind"]]).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(part)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(whole, a["at"] + 1, F.length(whole))))
    fields = [c for c in docs.columns]
    return rows.select(*[
        (F.when(F.size(ordered) > 0, masked).otherwise(whole) if c == text else F.col("__row")[c]).alias(c) for c in fields
    ])
