"""Text expressions on columns (no Python workers)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmart import schemas as S

WORD = r"[\p{L}\p{N}_]"
# White space beyond blank, tab and line ends, as Python's str.split() sees it.
RARE_BLANKS = r"[\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Composed Latin letters and their plain forms, position by position: all that decompose into a letter and marks.
_PLAIN_OF = {
    c: d[0]
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    if len(d := unicodedata.normalize("NFD", c)) > 1 and all("\u0300" <= m <= "\u036f" for m in d[1:])
}
ACCENTED, PLAIN = "".join(_PLAIN_OF), "".join(_PLAIN_OF.values())


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def word_count(c: Column) -> Column:
    """Number of white-space separated words, 0 for NULL."""
    text = strip(F.regexp_replace(c, RARE_BLANKS, " "))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, r"\s+")))


def without_marks(c: Column) -> Column:
    """Without diacritics: composed Latin letters and combining marks; empty for NULL."""
    composed = F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN)
    return F.regexp_replace(composed, r"[\x{300}-\x{36f}]", "")


def fold(c: Column) -> Column:
    """Lower-cased, trimmed, without diacritics."""
    return strip(F.lower(without_marks(c)))


def percent_encode(c: Column) -> Column:
    """RFC 3986 encoding that leaves '/', '~' and unreserved characters alone."""
    out = F.url_encode(c)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def search_query(query: Column, option: Column, exception: Column, site: Column, range_: Column) -> Column:
    """One search string out of the form fields; a fixed word when every field is empty."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    any_of = F.when(
        F.size(words(option)) > 1, F.concat(F.lit("("), F.array_join(words(option), " OR "), F.lit(")"))
    ).otherwise(option)
    none_of = F.array_join(F.transform(words(exception), lambda w: F.concat(F.lit("-"), w)), " ")
    when = F.trim(range_)
    cut = F.instr(when, " to ")
    after = F.when(
        cut > 0,
        F.concat(
            F.lit("after:"), F.substring(when, F.lit(1), cut - 1),
            F.lit(" before:"), F.substring(when, cut + 4, F.length(when)),
        ),
    ).otherwise(F.concat(F.lit("after:"), when))
    whole = F.concat_ws(
        " ",
        F.when(filled(query), query),
        F.when(filled(option), any_of),
        F.when(filled(exception) & (none_of != ""), none_of),
        F.when(filled(site), F.concat(F.lit("site:"), site)),
        F.when(filled(range_), after),
    )
    return F.when(whole == "", S.DEFAULT_QUERY).otherwise(whole)


def article_quota(n: Column) -> Column:
    """Requested number of articles, at most the fixed maximum."""
    return F.least(F.coalesce(n.try_cast("int"), F.lit(S.DEFAULT_ARTICLES)), F.lit(S.MAX_ARTICLES))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def clean_payload(c: Column) -> Column:
    """Payload text without tags and without javascript: prefixes."""
    return strip(F.regexp_replace(strip_tags(c), r"(?i)javascript:", ""))


def clean_question(c: Column) -> Column:
    """Chat question: trimmed, no tags, no NUL, known attack phrases masked, cut to the fixed length."""
    phrases = "|".join(p.replace(r"\b", rf"(?!{WORD})") for p in S.INJECTION_PHRASES)
    text = F.regexp_replace(strip_tags(strip(c)), r"\x00", "")
    return F.substring(F.regexp_replace(text, rf"(?i)({phrases})", "[REDACTED]"), 1, S.QUESTION_CHARS)


def intent(c: Column) -> Column:
    """ANALYTICAL when the question asks for a quantity, else SEMANTIC."""
    words = "|".join(S.QUANTITY_WORDS)
    edge = r"[^\p{L}\p{N}_]"
    hit = c.rlike(rf"(?i)(^|{edge})({words})($|{edge})")
    return F.when(hit, "ANALYTICAL").otherwise("SEMANTIC")


def question_keywords(c: Column, most: int = 5) -> Column:
    """First words of four or more letters that are no filler words; repeats stay."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in S.QUESTION_STOPWORDS])
    kept = F.filter(
        runs, lambda w: w.rlike("^[a-zA-ZáéíóúÁÉÍÓÚñÑ]{4,}$") & ~F.array_contains(stop, w)
    )
    return F.slice(kept, 1, most)


def citations(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[Article ID:\s*([a-zA-Z0-9_-]+)\]"), F.lit(1))


def fenced_sql(c: Column) -> Column:
    """SQL of the first ```sql block; bare text that starts with select; else NULL."""
    block = F.regexp_extract(c, r"(?is)```sql\s*(.*?)\s*```", 1)
    bare = strip(c)
    return F.when(c.rlike(r"(?is)```sql\s*.*?\s*```"), strip(block)).when(
        F.lower(bare).startswith("select"), bare
    )


def first_object(c: Column) -> Column:
    """The {...} part of free text once code fences are gone."""
    bare = strip(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    return blank_to_null(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))


def _holds_any(c: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def message_class(c: Column) -> Column:
    """error / complete / running out of a progress message: the first class of the table that has a word in it."""
    known = [F.when(_holds_any(c, exact) | _holds_any(F.lower(c), any_case), F.lit(name)) for name, exact, any_case in S.MESSAGE_CLASSES]
    return F.coalesce(*known, F.lit("running"))


def step_label(c: Column) -> Column:
    """English label of a progress step by the table of labels; the '(n/m)...' counter of a running analysis is kept."""
    counter = blank_to_null(F.regexp_extract(c, r"(?i)Anal(?:izando artículos|yzing articles)\s*(\(\d+/\d+\)\.\.\.)", 1))
    known = [F.when(_holds_any(c, words), F.lit(label)) for words, label in S.STEP_LABELS]
    return F.coalesce(F.concat(F.lit("Analyzing articles "), counter), *known, F.when(c != "", c), F.lit(S.DEFAULT_STEP))


def resolve_url(address: Column, base: Column) -> Column:
    """A page's relative address made whole by the page's own: rooted, beside it, or a query of it; '.' and '..' are walked."""
    part = lambda n: F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)", n)
    site, folder = F.concat(part(1), part(2)), F.regexp_replace(part(3), r"[^/]*$", "")
    path = F.regexp_extract(address, r"^[^?#]*", 0)
    rest = F.substring(address, F.char_length(path) + 1, F.char_length(address))
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    steps = F.split(whole, "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    walked = F.aggregate(
        steps, none, lambda done, s: F.when(s == "..", F.when(F.size(done) > 1, up(done)).otherwise(done)).when(s == ".", done).otherwise(F.array_append(done, s)))
    ends = F.element_at(steps, -1).isin(".", "..")
    joined = F.concat(F.array_join(walked, "/"), F.when(ends, "/").otherwise(""))
    return (
        F.when(address.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), address).when(address.startswith("//"), F.concat(part(1), address))
        .when(path == "", F.concat(site, part(3), rest)).otherwise(F.concat(site, joined, rest))
    )


def display_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def progress_share(current: Column, target: Column, base: float = 0.0, span: float = 100.0) -> Column:
    """base + span * current/target, never above base + span; a target below 1 counts as 1."""
    ratio = current / F.greatest(target, F.lit(1))
    return F.lit(base) + F.least(ratio * span, F.lit(span))
