"""Secrets in texts, by fixed patterns and by linking the parts of multipart credentials. DataFrame functions alone.

Base spans follow three fixed patterns (assign, access, hex). Besides, weak parts are gathered: identifiers (user,
login, account or client id assignments), secrets (short passwords or long mixed tokens that no base pattern takes) and
endpoints (URLs with a user part or a port, and host assignments). A weak identifier or secret is reported, as kind
``weak``, only if a complementary part, base spans included, starts within ``SCOPE`` code points of it in the same text.
That is an interval join on (document, cell of SCOPE code points) that keeps no pairs; a cell holds at most as many
parts as fit into it, so no key of the join is hot.

Positions come from the pieces that ``split`` leaves between the matches that ``regexp_extract_all`` gives. Offsets
count code points; ends are exclusive. Defined cases: a null or empty text has no spans and empty strings (the digest
is that of the empty string); rows without doc_id and rows that repeat one are told apart by a number of their own and
are scanned like any other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, text_rows

SCOPE = 400

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak parts, each with what must co-occur.
IDENTIFIER = r"""\b(?i:user(?:name)?|login|account_?id|client_?id|access_?id)["']?\x20?[:=]\x20?["']?[A-Za-z0-9_.@-]{3,}"""
WEAK_SECRET = r"""\b(?i:pwd|pass|pw|credential|client_?key|private_?key)["']?\x20?[:=]\x20?["']?[^\s"']{6,}"""
ENDPOINT = r"""\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"']{3,}|\b(?i:host|endpoint|server)["']?\x20?[:=]\x20?["']?[A-Za-z0-9.-]{3,}"""

BASE_KINDS = ("assign", "access", "hex")


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"
#: Matches that are placed together. Appending to an array copies it, so places are summed up within blocks of matches
#: and over the blocks, each of which is short even in a text of a million matches.
BLOCK = 256


def _matches(text: Column, pattern: str, kind: str, order: int, least: int = 0) -> Column:
    """Structs (start, order, end, kind) of the leftmost matches, in order. ``least`` is of the length of group 1.
    A text without a match is read once."""
    p = F.lit(pattern)
    lengths = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    group = F.transform(F.regexp_extract_all(text, p, F.lit(1)), F.length) if least else lengths
    gaps = F.transform(F.split(text, pattern, -1), F.length)  # one more than there are matches
    rows = F.arrays_zip(gaps.alias("gap"), lengths.alias("n"), group.alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["n"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"))
        # The last gap has no match, so its n is null.
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(x["g"] >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def moved(block: Column, by: Column) -> Column:
        return F.transform(block["found"], lambda x: F.struct((x["start"] + by).alias("start"), x["order"].alias("order"), (x["end"] + by).alias("end"), x["kind"].alias("kind")))

    def placed(blocks: Column) -> Column:
        sums = F.aggregate(blocks, F.array(F.lit(0)), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(sums, F.lit(1), F.size(blocks)), moved))

    def cut(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK)), lambda k: F.aggregate(F.slice(rows, k, F.lit(BLOCK)), start, step))

    none = F.array().cast(SPANS)
    return F.when(text.rlike(pattern), _bound(_bound(rows, cut), placed)).otherwise(none)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once; inside a lambda an outer expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and weak parts of every text, in one pass without a shuffle."""
    rows = text_rows(docs)
    t = F.col("text")
    base = F.concat(_matches(t, ASSIGN, "assign", 0, 6), _matches(t, ACCESS, "access", 1), _matches(t, HEX, "hex", 2))
    weak = F.concat(_matches(t, IDENTIFIER, "id", 3), _matches(t, WEAK_SECRET, "secret", 3), _matches(t, ENDPOINT, "endpoint", 3))
    return rows.select("doc_id", F.array_sort(base).alias("base"), weak.alias("weak"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def linked(rows: DataFrame) -> DataFrame:
    """Of ``parts`` with a row number: the weak identifiers and secrets that overlap no base span and that a complementary
    part is close to."""
    every = F.concat(F.transform("base", lambda s: F.struct(s["start"], s["end"], F.when(s["kind"] == "access", F.lit("id")).otherwise(F.lit("secret")).alias("role"), F.lit(False).alias("weak"))), F.transform("weak", lambda s: F.struct(s["start"], s["end"], s["kind"].alias("role"), F.lit(True).alias("weak"))))
    exploded = rows.filter(F.size("weak") > 0).select("row", F.explode(every).alias("p")).select("row", "p.*")
    # A weak part is free if no base span that starts before its end reaches beyond its start.
    # Frames that begin with the partition grow row by row; ones that end with it would be read anew for every row.
    up_to = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onwards = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.max(F.when(~F.col("weak"), F.col("end"))).over(up_to)
    next_base = F.min(F.when(~F.col("weak"), F.col("start"))).over(onwards)
    exploded = exploded.withColumn("free", F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(next_base >= F.col("end"), F.lit(True)))
    cell = F.floor(F.col("start") / SCOPE)
    right = exploded.select("row", cell.alias("cell"), F.col("start").alias("other_start"), F.col("role").alias("other_role"), F.col("end").alias("other_end"))
    left = exploded.filter("weak AND free AND role != 'endpoint'").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    near = F.abs(left["start"] - right["other_start"]) <= SCOPE
    complements = ((left["role"] == "id") & (right["other_role"] == "secret")) | ((left["role"] == "secret") & right["other_role"].isin("id", "endpoint"))
    apart = (left["end"] <= right["other_start"]) | (right["other_end"] <= left["start"])
    kept = left.join(right, (left["row"] == right["row"]) & (left["cell"] == right["cell"]) & near & complements & apart, "left_semi")
    span = F.struct(F.col("start"), F.lit(3).alias("order"), F.col("end"), F.lit("weak").alias("kind"))
    return kept.select("row", span.alias("span")).distinct().groupBy("row").agg(F.collect_list("span").alias("added"))


def scan(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, counts by kind, the base spans' digest and all spans by start and kind, one row for each row."""
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    rows = scratch.keep(parts(docs).withColumn("row", F.monotonically_increasing_id()), "parts")
    out = rows.join(linked(rows), "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS))))
    counts = [_count(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(spans).alias("spans"))
