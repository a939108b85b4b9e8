"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the hashes of its distinct shingles of ``shingle`` words. Two fixed permutations of the 32-bit
numbers make all ``COORDINATES`` of a signature: coordinate k is the least pi(sigma(x) + k) over the set, so pi is
shifted circularly by one place for each coordinate. ``BANDS`` bands of ``ROWS`` coordinates give buckets; a pair at
the threshold of 0.8 shares none with a probability of (1 - 0.8^4)^32 = 5e-8.

Documents with equal sets form a class that the row of its least doc_id stands for. In every bucket the members are verified on
their full sets against one pivot, the member that meets most others in buckets, and links make components. What is
left are pairs of different components that share a bucket. Let c be what a member has in common with the bucket's
pivot and x the shingles it has besides: two members have at most min(c, c') shingles of the pivot in common, so a pair
at the threshold either passes that bound alone, which an equi-join on set sizes finds, or shares shingles that the
pivot lacks, which an equi-join on a prefix of x finds. As two members' intersection is c + c' - |pivot| + how many
differences from the pivot they share, a 256-bit map of each one's differences then excludes nearly all. The few pairs are verified on their full sets as well. Thus a
group of thousands of near copies costs a number of verifications that is about linear in its size, no pairs within it
are listed, and no link between different texts is lost.

Words are lower-cased (A-Z) runs without ASCII white space. Defined cases: a null or empty text or one of white space
has no shingles and is linked with nothing; one with fewer words than a shingle has the whole sequence as its one
shingle; a row without doc_id has the class of its text like any other, and a component_id only if that class has an id;
rows that repeat a doc_id belong to the class of their own text, for all joins go by row numbers. ``drop_duplicates``
keeps one row of each component, that of the least doc_id (rows without one come last; of equals the first in the table),
and all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, arrow_strings, no_cycles, numbered, picked, release, ship, text_rows
from paperloom.llm.components import components

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
CACHE_WORDS = 200_000
MAP_BITS = 256
MAP_WORDS = MAP_BITS // 64
AT_ONCE = 256
#: Pairs with one pivot that a task may get at least.
SLICE = 256

U32, U64 = np.uint32, np.uint64


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Shingler:
    """Sets of shingle hashes; word hashes are remembered in a bounded table."""

    def __init__(self, size: int):
        self.size = size
        self.memory: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, U64)
        found = list(map(self.memory.get, words))
        if None in found:
            if len(self.memory) > CACHE_WORDS:
                self.memory.clear()
            digest, memory = xxhash.xxh3_64_intdigest, self.memory
            for k, (w, f) in enumerate(zip(words, found, strict=True)):
                if f is None:
                    found[k] = f = digest(w)
                    if len(w) <= 64:
                        memory[w] = f
        ids = np.array(found, U64)
        size = min(self.size, len(ids))
        h = np.full(len(ids) - size + 1, size, U64)
        for j in range(size):
            h = _scramble(h * U64(0x9E3779B97F4A7C15) + ids[j : len(ids) - size + 1 + j])
        return np.unique(h)


_SHIFTS = np.arange(COORDINATES, dtype=U32)


def sigma(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = (x ^ (x >> U32(16))) * U32(0x7FEB352D)
    x = (x ^ (x >> U32(15))) * U32(0x846CA68B)
    return x ^ (x >> U32(16))


def pi(x: np.ndarray) -> np.ndarray:
    """Another one; works in place."""
    x ^= x >> U32(16)
    x *= U32(0x85EBCA6B)
    x ^= x >> U32(13)
    x *= U32(0xC2B2AE35)
    x ^= x >> U32(16)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    placed = sigma((shingles >> U64(32)).astype(U32))
    out = np.full(COORDINATES, 0xFFFFFFFF, U32)
    for at in range(0, len(placed), AT_ONCE):
        out = np.minimum(out, pi(placed[at : at + AT_ONCE, None] + _SHIFTS).min(axis=0))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number included."""
    rows = sig.reshape(BANDS, ROWS).astype(U64)
    h = np.arange(1, BANDS + 1, dtype=U64)
    for j in range(ROWS):
        h = _scramble(h * U64(0x9E3779B97F4A7C15) + rows[:, j])
    return h.astype(np.int64)


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """Of (row, doc_id, text): row, doc_id, n_shingles, cls (128 bits of the set's hash) and bands."""
    ship(rows.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycles():
            release()
            own = Shingler(shingle)
            for batch in batches:
                sizes, cls, bands = [], [], []
                for text in arrow_strings(batch, "text"):
                    s = own.of(text)
                    sizes.append(len(s))
                    if len(s):
                        cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                        bands.append(band_keys(signature(s)))
                    else:
                        cls.append(None)
                        bands.append(None)
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(x, t) for x, t in zip((sizes, cls, bands), kinds, strict=True))], names=["row", "doc_id", "n_shingles", "cls", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sketch, f"row long, doc_id {kind}, n_shingles long, cls binary, bands array<long>")


def compared(pairs: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of row numbers with whether their full sets have 100 * intersection >= percent * union, the
    intersection's size, a prefix of the sorted shingles of b that a lacks, as long as a link between b and another can
    need, a's size, the number of the shingles that only one of the two has, and a 256-bit map of those.

    Only texts that are in pairs are shuffled. The text of an a with many pairs is copied to as many salts as its pairs
    fill slices of ``SLICE``, so no task gets all pairs of one."""
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    salted = pairs.join(slices, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int")).select("a", "b", "salt")
    texts_a = picked(rows, "row", pairs.select("a")).select(F.col("row").alias("a"), F.col("text").alias("text_a")).join(slices, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    texts_b = picked(rows, "row", pairs.select("b")).select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    rows = salted.join(texts_b, "b").join(texts_a, ["a", "salt"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = Shingler(shingle)
        last, last_set = None, None
        for batch in batches:
            linked, common, novel, sizes, apart, maps = [], [], [], [], [], []
            for ta, tb in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                ta = ta.as_py()
                if ta != last:
                    last, last_set = ta, own.of(ta)
                other = own.of(tb.as_py())
                new = np.setdiff1d(other, last_set, assume_unique=True)
                c = len(other) - len(new)
                linked.append(100 * c >= percent * (len(last_set) + len(new)))
                common.append(c)
                sizes.append(len(last_set))
                difference = np.concatenate([new, np.setdiff1d(last_set, other, assume_unique=True)])
                apart.append(len(difference))
                bits = np.zeros(MAP_BITS, np.uint8)
                bits[(difference % U64(MAP_BITS)).astype(np.int64)] = 1
                maps.append(np.packbits(bits).view(np.int64).tolist())
                novel.append(new[: len(other) * (100 - percent) // 100 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(common, pa.int64()), pa.array(novel, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(apart, pa.int64()), pa.array(maps, pa.list_(pa.int64()))],
                names=["a", "b", "linked", "c", "novel", "pivot_n", "d", "bits"],
            )

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, linked boolean, c long, novel array<long>, pivot_n long, d long, bits array<long>")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept, one row for each row."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    found = grouped(numbered(text_rows(docs), scratch), "doc_id", "text", shingle, percent, scratch)
    out = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def grouped(numbers: tuple[DataFrame, str], key: str, text: str, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """row, doc_id, n_shingles, component_id and stays (whether the row is the one that its component keeps) of a kept
    table of rows with numbers. Classes and components go by the number of a row that stands for them."""
    table, number = numbers
    rows = table.select(F.col(number).alias("row"), F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = scratch.keep(sketches(rows, shingle), "sketches")
    thin = every.select("row", "doc_id", "n_shingles", "cls")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    classes = scratch.keep(thin.filter("n_shingles > 0").groupBy("cls").agg(F.min(first).alias("first")).withColumn("rep", F.col("first.row")), "classes")
    reps = picked(every, "row", classes.select("rep"))
    placed = reps.select(F.col("row").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    met = placed.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("met")).filter("low < high").select("bucket", "met")
    buckets = scratch.keep(placed.join(met, "bucket"), "buckets")
    if buckets.isEmpty():
        return _placed(thin, classes, None)
    meetings = buckets.groupBy("id").agg(F.sum("met").alias("meetings"))
    pivots = buckets.join(meetings, "id").groupBy("bucket").agg(F.max(F.struct("meetings", (-F.col("id")).alias("minus"))).alias("best"))
    members = scratch.keep(buckets.select("bucket", "id", "n").join(pivots.select("bucket", (-F.col("best.minus")).alias("pivot")), "bucket").filter("id != pivot"), "members")
    scratch.drop("buckets")
    pairs = scratch.keep(members.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    known = scratch.keep(compared(pairs, rows, shingle, percent), "first")
    scratch.drop("pairs")
    roots = components(known.filter("linked").select("a", "b"), scratch, "roots")
    left = scratch.keep(_left_over(members, known, roots, percent), "left")
    if not left.isEmpty():
        more = scratch.keep(compared(left, rows, shingle, percent).filter("linked").select("a", "b"), "more")
        if not more.isEmpty():
            # The components so far are kept as stars: each node with its component's least node.
            roots = components(more.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))), scratch, "all-roots")
    return _placed(thin, classes, roots)


def _placed(thin: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is not None:
        own = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        # Links join different classes, so a component's classes are few against its rows, which the classes sum up.
        best = own.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("n")).filter("n > 1").select("root", "best")
        classes = own.join(best, "root", "left").select("cls", F.coalesce("best", "first").alias("first"))
    out = thin.join(classes.select("cls", "first"), "cls", "left")
    stays = F.coalesce(F.col("row") == F.col("first.row"), F.lit(True))
    return out.select("row", "doc_id", "n_shingles", F.col("first.id").alias("component_id"), stays.alias("stays"))


def _left_over(members: DataFrame, first: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that meet in a bucket and that the pivot's bounds don't exclude."""
    root = roots.select(F.col("node").alias("id"), "root")
    rows = members.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    of_pivot = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    rows = rows.join(of_pivot, "pivot", "left").withColumn("pivot_root", F.coalesce("pivot_root", "pivot"))
    # Only buckets with a member outside the pivot's component, beside another member, have pairs left.
    mixed = rows.groupBy("bucket").agg(F.max(F.col("root") != F.col("pivot_root")).alias("mixed"), F.count("*").alias("n_members")).filter("mixed AND n_members > 1").select("bucket")
    rows = rows.join(mixed, "bucket", "left_semi").select("pivot", "id", "n", "root", "pivot_root").distinct()
    rows = rows.join(first.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "c", "novel", "pivot_n", "d", *[F.col("bits")[k].alias(f"w{k}") for k in range(MAP_WORDS)]), ["pivot", "id"])
    least = rows.groupBy("pivot").agg(F.min("n").alias("least"))
    whole = F.lit(100 + percent)
    rows = rows.join(least, "pivot").withColumn("least", F.greatest("least", F.ceil(F.col("n") * percent / 100)))
    # A link with another member needs so many shingles that the pivot lacks, or none if this is not positive.
    needs = F.ceil(F.lit(percent) * (F.col("n") + F.col("least")) / whole) - F.col("c")
    rows = rows.withColumn("novel", F.slice("novel", F.lit(1), F.greatest(F.lit(0), F.col("n") - F.col("c") - F.greatest(needs, F.lit(1)) + 1).cast("int")))
    words = [f"w{k}" for k in range(MAP_WORDS)]
    # Differences that share a bit with another: how far the map can undercount.
    rows = rows.withColumn("x", F.col("n") - F.col("c")).withColumn("spare", F.col("d") - sum(F.bit_count(w) for w in words))

    def side(df: DataFrame, mark: str, *keep: str) -> DataFrame:
        return df.select("pivot", *keep, *[F.col(k).alias(f"{k}{mark}") for k in ("id", "n", "c", "x", "root", "pivot_n", "spare", *words)])

    outside = rows.filter("root != pivot_root")
    differ = (F.col("root1") != F.col("root2")) & (F.lit(100) * F.least("n1", "n2") >= F.lit(percent) * F.greatest("n1", "n2"))
    bound = F.lit(percent) * (F.col("n1") + F.col("n2"))
    shared = sum(F.bit_count(F.col(f"{w}1").bitwiseAND(F.col(f"{w}2"))) for w in words) + F.least("spare1", "spare2")
    differ = differ & (whole * (F.col("c1") + F.col("c2") - F.col("pivot_n1") + shared) >= bound)
    by_novel = side(outside.withColumn("s", F.explode("novel")), "1", "s").join(side(rows.withColumn("s", F.explode("novel")), "2", "s"), ["pivot", "s"])
    by_novel = by_novel.filter(differ & (whole * (F.least("c1", "c2") + F.least("x1", "x2")) >= bound))
    sizes = F.sequence(F.ceil(F.col("n") * percent / 100), F.floor(whole * F.col("c") / percent).cast("long") - F.col("n"))
    reach = outside.filter(whole * F.col("c") >= F.lit(percent) * (F.col("n") + F.ceil(F.col("n") * percent / 100)))
    by_size = side(reach.withColumn("size", F.explode(sizes)), "1", "size").join(side(rows.withColumn("size", F.col("n")), "2", "size"), ["pivot", "size"])
    by_size = by_size.filter(differ & (whole * F.least("c1", "c2") >= bound))
    pair = [F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")]
    return by_novel.select(*pair).unionByName(by_size.select(*pair)).distinct()


def drop_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns as they are, that their components keep: one of each component."""
    scratch, steps = (Scratch(docs.sparkSession, "minhash") for _ in range(2))
    table, number = numbered(docs, scratch)
    gone = scratch.keep(grouped((table, number), "doc_id", "text", shingle, percent, steps).filter(~F.col("stays")).select("row"), "gone")
    steps.clear()
    return picked(table, number, gone, others=True).drop(number)
