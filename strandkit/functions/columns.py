"""Derived columns of an annotated sequence corpus, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandkit import constants as C


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _null_if_blank(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def clean_sequence(seq: Column) -> Column:
    """Whitespace removed, upper case, trailing asterisks dropped."""
    return F.regexp_replace(F.upper(F.regexp_replace(seq, r"\s+", "")), r"\*+$", "")


def foreign_symbols(seq: Column, alphabet: str = C.AMINO_ACIDS) -> Column:
    """Sorted distinct symbols of ``seq`` outside the alphabet."""
    rest = F.translate(seq, alphabet, "")
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.split(rest, "")))
    )


def validation_reason(
    seq: Column, min_length: int, max_length: int, alphabet: str = C.AMINO_ACIDS
) -> Column:
    """Why a cleaned sequence is refused, or null when it is valid."""
    size = F.length(seq)
    foreign = foreign_symbols(seq, alphabet)
    return (
        F.when(seq.isNull() | (size == 0), F.lit("empty"))
        .when(size < min_length, F.concat(F.lit("short:"), size.cast("string")))
        .when(size > max_length, F.concat(F.lit("long:"), size.cast("string")))
        .when(F.size(foreign) > 0, F.concat(F.lit("symbols:"), F.concat_ws(",", foreign)))
    )


def family(text: Column) -> Column:
    """First segment before ``;`` and ``,``, trimmed; blank becomes null."""
    return _null_if_blank(
        F.trim(F.substring_index(F.substring_index(text, ";", 1), ",", 1))
    )


def token_list(text: Column) -> Column:
    """Parts of a ``;`` list without empty ones; null gives an empty list."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), ";")
    return F.filter(parts, lambda p: p != "")


def first_token(tokens: Column) -> Column:
    return F.get(tokens, F.lit(0))


def ec_class(text: Column) -> Column:
    digit = F.regexp_extract(F.trim(text), r"^\s*([^;.]*)", 1)
    return F.try_element_at(_literal_map(C.EC_CLASSES), F.trim(digit))


def is_enzyme(ec: Column) -> Column:
    return F.coalesce(F.trim(ec) != "", F.lit(False))


def localization(text: Column, patterns: list[tuple[str, str]] = C.LOCATION_PATTERNS) -> Column:
    """First label of the ordered vocabulary whose pattern is found in the text."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.rlike(pattern), F.lit(label)) for label, pattern in patterns])


def name_head(text: Column) -> Column:
    return F.trim(F.substring_index(F.coalesce(text, F.lit("")), " (", 1))


def organism_short(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(text, r"\(.*", "")), r"\s+")
    return F.when(
        F.size(words) >= 2,
        F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.lit(". "), F.get(words, F.lit(1))),
    ).otherwise(text)


def keyword_list(text: Column, limit: int = 20) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, limit)


def normal_accession(text: Column) -> Column:
    return F.upper(F.trim(text))


def accession_ok(text: Column) -> Column:
    return normal_accession(text).rlike(C.ACCESSION_PATTERN)


def substitution(text: Column, alphabet: str = C.AMINO_ACIDS) -> Column:
    """Struct (wt, pos, mut, reason) of a label like ``H63Y``."""
    label = F.upper(F.trim(text))
    wt = F.regexp_extract(label, C.SUBSTITUTION_PATTERN, 1)
    pos = F.regexp_extract(label, C.SUBSTITUTION_PATTERN, 2)
    mut = F.regexp_extract(label, C.SUBSTITUTION_PATTERN, 3)
    reason = (
        F.when(F.coalesce(wt, F.lit("")) == "", F.lit("unparsed"))
        .when(~F.contains(F.lit(alphabet), wt), F.lit("wild-type symbol"))
        .when(~F.contains(F.lit(alphabet), mut), F.lit("mutant symbol"))
    )
    parsed = reason.isNull() | (reason != "unparsed")
    return F.struct(
        F.when(parsed, wt).alias("wt"),
        F.when(parsed, pos.try_cast("int")).alias("pos"),
        F.when(parsed, mut).alias("mut"),
        reason.alias("reason"),
    )


def hgvs_substitution(text: Column) -> Column:
    """Struct (wt, pos, mut) of ``p.Gly34Arg``; null unless a clean substitution."""
    label = F.trim(text)
    codes = _literal_map(C.THREE_LETTER_CODES)
    wt = F.try_element_at(codes, F.regexp_extract(label, C.HGVS_PATTERN, 1))
    mut = F.try_element_at(codes, F.regexp_extract(label, C.HGVS_PATTERN, 3))
    pos = F.regexp_extract(label, C.HGVS_PATTERN, 2).try_cast("int")
    return F.when(
        wt.isNotNull() & mut.isNotNull() & (wt != mut),
        F.struct(wt.alias("wt"), pos.alias("pos"), mut.alias("mut")),
    )


def substitution_reason(seq: Column, wt: Column, pos: Column, mut: Column) -> Column:
    found = F.substring(seq, pos, F.lit(1))
    return (
        F.when((pos < 1) | (pos > F.length(seq)), F.lit("position"))
        .when(found != wt, F.concat(F.lit("wild-type:"), found))
        .when(found == mut, F.lit("identity"))
    )


def apply_substitution(seq: Column, pos: Column, mut: Column) -> Column:
    return F.overlay(seq, mut, pos, F.lit(1))


def region_reason(
    start: Column, end: Column, length: Column, min_span: int = C.MIN_REGION_SPAN
) -> Column:
    return (
        F.when((start < 1) | (end > length), F.lit("outside"))
        .when(end < start, F.lit("inverted"))
        .when(end - start + 1 < min_span, F.lit("short"))
    )


def class_counts(seq: Column, classes: dict[str, str] = C.SYMBOL_CLASSES) -> list[Column]:
    """One count column per symbol class."""
    return [
        F.regexp_count(seq, F.lit(f"[{symbols}]")).cast("long").alias(f"n_{name}")
        for name, symbols in classes.items()
    ]


def symbol_class(symbol: Column, classes: dict[str, str] = C.SYMBOL_CLASSES) -> Column:
    flat = {s: name for name, symbols in classes.items() for s in symbols}
    return F.try_element_at(_literal_map(flat), symbol)


def spaced_form(seq: Column, prefix: str = C.STRUCTURE_PREFIX, rare: str = C.RARE_SYMBOLS) -> Column:
    masked = F.regexp_replace(F.upper(seq), f"[{rare}]", "X")
    return F.concat(F.lit(prefix + " "), F.concat_ws(" ", F.split(masked, "")))


def embedding_key(
    seq: Column, model: str, pooling: str, fingerprint: str | None = None,
    version: str = C.EMBEDDING_VERSION,
) -> Column:
    head = f"{model}|{pooling}|v{version}|{fingerprint or '-'}|"
    return F.sha2(F.concat(F.lit(head), seq), 256)


def fasta_record(ident: Column, name: Column, seq: Column, wrap: int | None = None) -> Column:
    body = seq if not wrap else F.regexp_replace(seq, f"(.{{{wrap}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), ident, F.lit(" "), name, F.lit("\n"), body)


def summary_struct(prefix: str = "") -> Column:
    """The nine fields shown for a corpus row."""
    c = lambda name: F.col(prefix + name)
    return F.struct(
        c("accession").alias("accession"), c("protein_name").alias("name"),
        c("gene").alias("gene"), c("organism_short").alias("organism"),
        c("length").alias("length"), c("family").alias("family"),
        c("pfam_primary").alias("pfam"), c("ec_class").alias("ec_class"),
        c("localization").alias("localization"),
    )


def perturbation(metric: str) -> Column:
    """Ranking value: the larger, the stronger the effect of a substitution."""
    if metric == "cosine":
        return 1 - F.col("cosine")
    if metric == "llr":
        return -F.col("llr")
    return F.col(metric)


def task_labels() -> list[Column]:
    """Label columns of the three probe tasks."""
    return [
        F.when(F.col("is_enzyme"), "enzyme").otherwise("non-enzyme").alias("enzyme_vs_nonenzyme"),
        F.when(F.col("is_enzyme"), F.col("ec_class")).alias("ec_class"),
        F.col("localization").alias("subcellular_localization"),
    ]


def hash_order(seed: int, *keys: Column) -> Column:
    """Reproducible random order: md5 of the seed and the row's key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_fraction(seed: int, *keys: Column) -> Column:
    """A uniform number in (0, 1) from the first 52 bits of ``hash_order``, as many as a double holds."""
    head = F.conv(F.substring(hash_order(seed, *keys), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / 4503599627370496.0


def hash_index(seed: int, bound: Column, *keys: Column) -> Column:
    """A whole number in [0, bound) from 60 bits, near uniform for any row count."""
    head = F.conv(F.substring(hash_order(seed, *keys), 1, 15), 16, 10).cast("long")
    return F.pmod(head, bound)


def permuted(seed: int, bound: Column, position: Column, *keys: Column, rounds: int = 24) -> Column:
    """The place of ``position`` in a random order of 0 .. bound - 1 that ``seed`` and ``keys`` name.

    A swap-or-not shuffle: each round pairs x with K - x (mod bound) for a hashed K and swaps
    the two or not by a hashed bit of the pair.  Every round is a permutation for any bound, so
    draws at different positions never meet, and no order is stored or sorted.
    """
    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(hash_index(seed, bound, *keys, r) - x, bound)
        flip = hash_index(seed + 1, F.lit(2), *keys, r, F.greatest(x, other)) == 1
        return F.when(flip, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), position.cast("long"), turn)
