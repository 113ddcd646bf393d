"""Personal data by regular expressions, checksum validators and context words, in DataFrame functions only.

A kind's pattern proposes spans, leftmost and not overlapping. Places come from cutting the text at the matches: the pieces
between them and the matches themselves alternate, so running lengths give each span's code points. A validator then drops
spans (Luhn digits of cards, mod 97 of account numbers, ranges of address parts), and context words shortly before a span
raise its score. Patterns take whole runs of characters at once and begin only where a run begins (or the last match
ended), so a long run costs no more than its length and finds the same spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters before a span in which context words count.
CONTEXT = 40


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass the Luhn check."""
    def total(d: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            n = F.substring(d, -i, F.lit(1)).cast("int")
            twice = n * 2
            return acc + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(n)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)

    return F.element_at(F.transform(F.array(_digits(match)), total), 1) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether ``match`` (letters and digits, spaces aside) passes the account-number check: its first four characters put
    last and letters read as 10 to 35, the number leaves 1 by 97."""
    def rest(s: Column) -> Column:
        turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))

        def step(acc: Column, c: Column) -> Column:
            n = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
            return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97

        return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))

    return F.element_at(F.transform(F.array(F.regexp_replace(match, " ", "")), rest), 1) == 1


def _length(match: Column, low: int, high: int) -> Column:
    return F.length(_digits(match)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """needs: a cheap test of the whole text; valid: of a match; score: without and with a context word before it."""

    name: str
    pattern: str
    needs: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    context: str
    scores: tuple[float, float]


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: The first four are the base kinds, in the order of the output.
KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"),
        lambda m: F.lit(True), "mail|contact|write", (0.9, 1.0),
    ),
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"),
        lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), "address|server|host|ip", (0.6, 0.9),
    ),
    Kind(
        "card", r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++", lambda t: t.rlike(r"[0-9][ -]?[0-9]"),
        lambda m: F.when(_length(m, 14, 19), luhn(m)).otherwise(False), "card|credit|visa|pay", (0.8, 1.0),
    ),
    Kind(
        "phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: _length(m, 10, 15), "phone|call|tel|mobile", (0.7, 0.95),
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
        mod97, "iban|account|bank|transfer", (0.9, 1.0),
    ),
)
BASE = ("email", "ip", "card", "phone")


def kind_spans(text: Column, kind: Kind, at: int) -> Column:
    """Array of (start, kind number, end, kind, score) of the valid spans of one kind, in code points."""
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")

    def spans(found: Column) -> Column:
        pieces, matches = found["pieces"], found["matches"]
        ends = F.aggregate(
            F.sequence(F.lit(1), F.size(matches)), F.array().cast("array<int>"),
            lambda acc, i: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.char_length(F.get(pieces, i - 1)) + F.char_length(F.get(matches, i - 1))),
        )
        return F.element_at(F.transform(F.array(ends), lambda e: valid(pieces, matches, e)), 1)

    def valid(pieces: Column, matches: Column, ends: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            lead = F.lower(F.substring(F.get(pieces, i), -CONTEXT, CONTEXT))  # what stands before, up to the kind's last match
            score = F.when(lead.rlike(rf"\b(?:{kind.context})"), kind.scores[1]).otherwise(kind.scores[0])
            end = F.get(ends, i)
            return F.when(kind.valid(m), F.struct((end - F.char_length(m)).alias("start"), F.lit(at).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score")))

        return F.array_compact(F.transform(matches, span))

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    found = F.struct(F.split(text, kind.pattern, -1).alias("pieces"), matches.alias("matches"))
    some = F.element_at(F.transform(F.array(found), lambda f: F.when(F.size(f["matches"]) > 0, spans(f)).otherwise(nothing)), 1)
    return F.when(kind.needs(text), some).otherwise(nothing)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, spans) for every row: array of (start, rank, end, kind, score), by start and then kind. Null texts count as
    empty; a text without personal data has an empty array."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    rows = rows.select("doc_id", *(kind_spans(F.col("_t"), kind, i).alias(f"_{i}") for i, kind in enumerate(kinds)))
    return rows.select("doc_id", F.sort_array(F.concat(*(f"_{i}" for i in range(len(kinds))))).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *(count_of(F.col("spans"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
