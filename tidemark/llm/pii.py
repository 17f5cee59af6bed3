"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, table


class Kind(NamedTuple):
    """A pattern and what it is worth: ``base`` if it matches, more if its checksum holds and if a word is near.

    The patterns scan in linear time. A start is tried only where a run begins
    or the last match ended, and repetitions are possessive, so neither very
    long runs nor long matches cost more than their length.
    """

    name: str
    pattern: str
    base: float
    checked: float = 0.0
    context: str = ""
    near: float = 0.3


# Context words of the added kinds.
BANK_WORDS = "iban|bank|account|konto|cuenta|compte|transfer"
SOCIAL_WORDS = "ssn|social security|social-security"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 1.0),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", 1.0),
    # Runs of fewer than 16 digits fail the check anyway; leaving them out here changes no other match.
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", 0.5, 0.5),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 1.0),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         0.2, 0.5, BANK_WORDS),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", 0.3, 0.0, SOCIAL_WORDS),
)
BASE_KINDS = ("email", "ip", "card", "phone")
ACCEPTED = 0.5
CONTEXT_CHARS = 48


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn: from the right, every second digit counts twice."""
    places = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(
            F.filter(places, lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def mod_97(code: Column) -> Column:
    """Whether an account code, its first four characters moved to the end and letters read as 10-35, is 1 modulo 97."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return (F.length(digits(hit)) <= 19) & luhn(digits(hit))
    if kind == "phone":
        return F.length(digits(hit)).between(8, 15)
    if kind == "iban":
        return mod_97(F.replace(hit, F.lit(" "), F.lit("")))
    return F.lit(True)


def block_of(lengths: str) -> Column:
    return F.ceil(F.sqrt(F.size(lengths))).cast("int")


def added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def block_sums(lengths: str) -> Column:
    """The sums of an array column over blocks of about the square root of its length."""
    block = block_of(lengths)
    return F.transform(
        F.sequence(F.lit(0), block - 1), lambda b: added(F.slice(F.col(lengths), b * block + 1, block))
    )


def running_sums(lengths: str, starts: str) -> Column:
    """The sum up to and including each element. ``starts``: the sum before each block.

    By blocks, since adding from the start for each element would cost the
    square of the length.
    """
    block = block_of(lengths)
    return F.flatten(
        F.transform(
            F.col(starts),
            lambda start, b: F.transform(
                F.slice(F.col(lengths), b * block + 1, block),
                lambda _, i: start + added(F.slice(F.col(lengths), b * block + 1, i + 1)),
            ),
        )
    )


def find_spans(docs: DataFrame, context_chars: int = CONTEXT_CHARS, accepted: float = ACCEPTED) -> DataFrame:
    """``doc_id`` and ``spans``: array of ``kind, start, end, score``, by kind as listed, then start.

    Offsets are code points, ends exclusive. A pattern's matches and the pieces
    between them come from two built-in functions; the running sum of their
    lengths gives the places. A base kind stays if its match is valid, whatever
    its score; an added kind (``iban``, ``ssn``) needs a score of ``accepted``,
    to which a holding checksum and a word of its context within
    ``context_chars`` characters add. Null and empty texts have no spans;
    repeated rows are treated alike, each for itself.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("*", *(F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"{k.name}_hits") for k in KINDS))
    none = F.array().cast("array<int>")
    df = df.select(
        "*",
        *(
            F.when(
                F.size(f"{k.name}_hits") > 0,
                F.flatten(
                    F.zip_with(
                        F.transform(F.split("text", k.pattern, -1), lambda x: F.length(x)),
                        F.transform(f"{k.name}_hits", lambda x: F.length(x)),
                        lambda gap, hit: F.array(gap, F.coalesce(hit, F.lit(0))),
                    )
                ),
            )
            .otherwise(none)
            .alias(f"{k.name}_lengths")
            for k in KINDS
        ),
    )
    for name, step in (
        ("sums", lambda k: block_sums(f"{k}_lengths")),
        ("starts", lambda k: F.transform(f"{k}_sums", lambda _, b: added(F.slice(f"{k}_sums", 1, b)))),
        ("ends", lambda k: running_sums(f"{k}_lengths", f"{k}_starts")),
    ):
        df = df.select(
            "*",
            *(F.when(F.size(f"{k.name}_hits") > 0, step(k.name)).otherwise(none).alias(f"{k.name}_{name}") for k in KINDS),
        )
    return df.select("doc_id", F.concat(*(scored(k, context_chars, accepted) for k in KINDS)).alias("spans"))


def scored(kind: Kind, context_chars: int, accepted: float) -> Column:
    """The spans of one kind. Ends alternate: after a gap (a match starts), after a match."""

    def span(hit: Column, i: Column) -> Column:
        start = F.element_at(f"{kind.name}_ends", i * 2 + 1)
        end = F.element_at(f"{kind.name}_ends", i * 2 + 2)
        holds = valid(kind.name, hit)
        score = F.lit(kind.base) + F.when(holds, kind.checked).otherwise(0.0)
        if kind.context:
            first = F.greatest(start - context_chars, F.lit(0))
            around = F.concat(
                F.substr("text", first + 1, start - first), F.lit(" "), F.substr("text", end + 1, F.lit(context_chars))
            )
            score = score + F.when(F.lower(around).rlike(rf"\b(?:{kind.context})\b"), kind.near).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"), holds.alias("holds")
        )

    spans = F.transform(f"{kind.name}_hits", span)
    stays = (lambda s: s.holds) if kind.name in BASE_KINDS else (lambda s: s.score >= accepted)
    return F.transform(
        F.filter(spans, stays), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.score.alias("score"))
    )


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","
    )


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in each document."""
    df = find_spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s.kind)
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    return df.select(
        "doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
