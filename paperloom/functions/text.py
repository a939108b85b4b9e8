"""Column functions over text: normalisation, phrases, sentences, terms, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a sentence's topic.
STOP = (
    "a an and are as at be been but by for from has have had he her his i if in into is it its of on or our she "
    "that the their there these they this to was we were which will with you your not no can may also such than then so do does "
    "did more most other some any each all both about over under between during after before while where when who whom what"
).split()

SENTENCE_BREAK = r"""(?<=[.!?])\s+(?=[A-Z0-9"'“(\[])"""
MIN_WORDS, MAX_WORDS = 6, 60
CONTEXT = 50
#: Letters that number 2^63 - 1 needs.
MAX_LETTERS = 14


def squeezed(text: Column) -> Column:
    """White-space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def margin_key(text: Column) -> Column:
    """What running headers have in common: lower case, single spaces, digits as #."""
    return F.regexp_replace(F.lower(squeezed(text)), r"[0-9]+", "#")


def phrase(query: str) -> str:
    """A search phrase in single-spaced lower case; one pair of quotes around it goes, a blank one is an error."""
    q = query.strip()
    if len(q) >= 2 and q[0] == q[-1] and q[0] in "\"'“”":
        q = q[1:-1].strip()
    if not q.split():
        raise ValueError("query must not be blank")
    return " ".join(q.split()).lower()


def phrase_count(text: Column, query: str) -> Column:
    """Matches in single-spaced text, regardless of case, without overlap."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(query), F.lit("")))) / F.lit(len(query))).cast("long")


def snippet(text: Column, start: Column, length: int, context: int = CONTEXT) -> Column:
    """The match at the 1-based start with so many characters around it; dots where text is left out."""
    a = F.greatest(F.lit(1), start - context)
    b = F.least(F.length(text) + 1, start + length + context)
    return F.concat(F.when(a > 1, "...").otherwise(""), F.substring(text, a, b - a), F.when(b <= F.length(text), "...").otherwise(""))


def sentences(text: Column) -> Column:
    """Structs (i, sentence) of the pieces that read as sentences."""
    pieces = F.split(squeezed(text), SENTENCE_BREAK)
    indexed = F.transform(pieces, lambda s, i: F.struct(i.alias("i"), F.trim(s).alias("sentence")))

    def good(x: Column) -> Column:
        s = x["sentence"]
        n = F.size(F.split(s, " "))
        letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
        solid = F.length(F.replace(s, F.lit(" "), F.lit("")))
        ended = s.rlike(r"""[.!?"')”]$""") | ((x["i"] == F.size(pieces) - 1) & (n >= 2 * MIN_WORDS))
        return (n >= MIN_WORDS) & (n <= MAX_WORDS) & (letters >= 0.6 * solid) & ended

    return F.filter(indexed, good)


def terms(text: Column) -> Column:
    """Lower-case words of three letters or more that are not stop words, repeats kept."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z\-']{2,}"), F.lit(0)), F.lower)
    return F.filter(found, lambda w: ~w.isin(STOP))


def safe_name(name: Column) -> Column:
    return F.right(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), F.lit(120))


def column_number(letters: Column) -> Column:
    """A1 letters to a 1-based number."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + (F.ascii(c) - 64)))


def column_name(number: Column) -> Column:
    """1-based number (an integer of up to 64 bits) to A1 letters."""

    def letter(n: Column) -> Column:
        return F.char(n % 26 + 65)

    rest = number.cast("long") - 1
    letters = [letter(rest)]
    for _ in range(MAX_LETTERS - 1):
        rest = F.call_function("div", rest, F.lit(26)) - 1
        letters.insert(0, F.when(rest >= 0, letter(rest)).otherwise(""))
    return F.concat(*letters)


def unit_of(label: Column) -> Column:
    """The unit of an axis label: in brackets, or after "in"."""
    bracket, word = F.regexp_extract(label, r"\(([^)]+)\)", 1), F.regexp_extract(label, r"\bin\s+(\S+)\s*$", 1)
    return F.when(bracket != "", bracket).when(word != "", word)
