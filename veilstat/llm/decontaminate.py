"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Texts become word tokens; numbers, capitalised words and units after a number become typed slots, all else is in lower case. A
window is ``width`` consecutive tokens (an item with fewer is one window of its own length). Windows of documents meet
windows of benchmark items by the hash of their template, and, whatever the case of either, by the hash of their words in lower
case. Adjacent slots of one type are one place of a template, so a name of two words can stand for a name of one.
Meetings of one document, item and kind at one offset, or at offsets at most ``near`` from the next, are an alignment; slots met by template
must be consistent: a value in the item stands for one value in the document, and the reverse. So a question with new numbers and names
is caught, and a chance meeting of templates is not. Offsets that are inconsistent alone are left out.

An alignment is a leak if ``cover`` of the item's windows meet, word for word or by templates with consistent slots.
Windows between two that meet, broken by an edit of at most ``near`` words put in, left out or replaced, count as met for this.
Windows with fewer than ``literal`` words that are no slots in the item say little and are left out; an item that has
no others keeps them and must meet word for word.

A table of ``PLACES`` bits, set at the places that the benchmark's hashes point to, goes to all tasks; windows of documents whose place has no
bit set are left out where they are made. The benchmark's windows are broadcast when they take at most ``small`` bytes; else both sides
are shuffled by the hash. Either way the same windows meet. Documents are read once and only meetings are shuffled; a
window that meets many items or documents is only as many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch, let

#: Unit words, as they follow a number.
UNITS = "% $ € £ mm cm m km in ft yd mi g kg mg t lb oz l ml s sec min h hr ms inch inches foot feet yard yards mile miles meter meters metre metres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degrees".split()
PLACES = 1 << 19
TOKEN = r"\p{N}[\p{N}.,]*|[\p{L}\p{M}]+|[$€£%]"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _slot(raw: Column, x: Column, i: Column) -> Column:
    """1 number, 2 name, 3 unit, 0 none.

    Words are compared in byte order: those from "a" up to "{" begin with a to z, those from "0" up to ":" with a digit. Only what
    begins otherwise needs a pattern.
    """
    first, before = F.substring(x, 1, 1), F.get(raw, i - 1)
    other = lambda c: (c >= "\x80") & c.rlike(r"^\p{N}")
    unit = (before >= "0") & ((before < ":") | other(before)) & F.lower(x).isin(*UNITS)
    number = ((x >= "0") & (x < ":")) | other(x)
    return F.when((x >= "a") & (x < "{"), F.when(unit, 3).otherwise(0)).when(first != F.lower(first), 2).when(number, 1).when(unit, 3).otherwise(0)


def place(h: Column) -> tuple[Column, Column]:
    """The number and the bit in it that a hash points to in the table of marks."""
    return F.shiftrightunsigned(h, 64 - (PLACES // 64).bit_length() + 1).cast("int"), h.bitwiseAND(63).cast("int")


def marked(h: Column, marks: Column) -> Column:
    """Whether the hash points to a bit that is set."""
    word, bit = place(h)
    return F.getbit(F.get(marks, word), bit) == 1


def runs(x: Column, n: int, kind: int) -> Column:
    """Hash of the n numbers from each place on and of ``kind``: of two neighbouring runs that are half as long, and so on down."""
    none = F.array().cast("array<bigint>")
    if n == 1:
        return F.transform(x, lambda a: F.xxhash64(F.lit(kind), a))
    half = 1 << (n - 1).bit_length() - 1
    both = lambda a, b: F.xxhash64(F.lit(kind), a, b)

    def of(g: Column, r: Column) -> Column:
        # Runs of ``half``, and of the rest behind each of them; there are as many as of the rest but the first ``half``.
        m = F.size(r) - half
        return F.when(m > 0, F.zip_with(F.slice(g, 1, m), F.slice(r, half + 1, m), both)).otherwise(none)

    if n == 2 * half:
        return let(runs(x, half, kind) if half > 1 else x, lambda g: of(g, g))
    return let(runs(x, half, kind) if half > 1 else x, lambda g: of(g, runs(x, n - half, kind) if n - half > 1 else x))


def windows(rows: DataFrame, key: list[str], sizes: list[int], typed_sizes: list[int], marks: list[int] | None = None) -> DataFrame:
    """key, literal, at, size, h, and what the hash leaves open: windows of words by their words (literal), and windows of places by
    their template. ``own`` has the window's words as hashes in lower case, ``slot`` the slot of each word or place, ``starts`` the first
    word of each place and one beyond the last. The two kinds never share a hash. With ``marks`` these are windows of documents: only
    those whose hash points to a mark, without the slots, and literal ones without any of these."""
    item = marks is None
    bits = F.array().cast("array<bigint>") if item else F.split(F.lit(",".join(map(str, marks))), ",").cast("array<bigint>")

    def made(raw: Column) -> Column:
        return let(F.transform(raw, lambda x, i: F.struct(_slot(raw, x, i).alias("slot"), F.xxhash64(F.lower(x)).alias("own"), i.alias("i"))), lambda t: let(
            F.struct(
                t["own"].alias("own"),
                t["slot"].alias("slot"),
                _places(t).alias("places"),
            ),
            lambda p: let(
                F.struct(
                    p["own"].alias("own"),
                    p["slot"].alias("slot"),
                    p["places"]["slot"].alias("place_slot"),
                    F.transform(p["places"], lambda x: F.when(x["slot"] > 0, x["slot"].cast("long")).otherwise(x["own"])).alias("form"),
                    F.concat(p["places"]["i"], F.array(F.size(p["own"]))).alias("starts"),
                    bits.alias("bits"),
                ),
                lambda q: F.concat(*[literal(q, n) for n in sizes], *[typed(q, n) for n in typed_sizes]),
            ),
        ))

    def each(q: Column, hashes: Column, window: Callable[[Column, Column], Column]) -> Column:
        """The windows at all places, or at those whose hash is marked."""

        def of(hs: Column) -> Column:
            places = F.when(F.size(hs) > 0, F.sequence(F.lit(1), F.size(hs))).otherwise(F.array().cast("array<int>"))
            pair = lambda i, h: F.struct(i.alias("i"), h.alias("h"))
            if item:
                found = F.zip_with(places, hs, pair)
            else:
                found = F.filter(F.zip_with(places, hs, lambda i, h: F.when(marked(h, q["bits"]), pair(i, h))), lambda w: w.isNotNull())
            return F.transform(found, lambda w: window(w["i"], w["h"]))

        return let(hashes, of)

    def window(kind: bool, i: Column, n: int, h: Column, own: Column | None, slot: Column | None, starts: Column | None) -> Column:
        none = lambda x, kind: (F.lit(None) if x is None else x).cast(f"array<{kind}>")
        return F.struct(F.lit(kind).alias("literal"), i.alias("at"), F.lit(n).alias("size"), h.alias("h"), none(own, "bigint").alias("own"), none(slot, "int").alias("slot"), none(starts, "int").alias("starts"))

    def literal(q: Column, n: int) -> Column:
        return each(q, runs(q["own"], n, -n), lambda i, h: window(True, i, n, h, None, F.slice(q["slot"], i, n) if item else None, None))

    def typed(q: Column, n: int) -> Column:
        start = lambda i: F.get(q["starts"], i - 1)
        own = lambda i: F.slice(q["own"], start(i) + 1, start(i + n) - start(i))
        return each(q, runs(q["form"], n, n), lambda i, h: window(False, i, n, h, own(i), F.slice(q["place_slot"], i, n) if item else None, F.slice(q["starts"], i, n + 1)))

    return rows.select(*key, F.inline(let(_tokens(F.col("text")), made)))


def _places(t: Column) -> Column:
    """The words (slot, own, i) that start a place: each word that is no slot, and the first of adjacent slots of one type."""
    return F.filter(t, lambda x, i: (x["slot"] == 0) | (i == 0) | (F.get(t, i - 1)["slot"] != x["slot"]))


def _filled() -> Column:
    """slot, a, b: what fills each slot in the item and in the document; word by word where both have as many words."""
    part = lambda own, starts, k: F.slice(own, F.get(starts, k) - F.get(starts, F.lit(0)) + 1, F.get(starts, k + 1) - F.get(starts, k))

    def pairs(s: Column, k: Column) -> Column:
        return let(F.struct(part(F.col("item_own"), F.col("item_starts"), k).alias("a"), part(F.col("own"), F.col("starts"), k).alias("b")), lambda p: (
            F.when(s == 0, F.array().cast("array<struct<slot:int,a:bigint,b:bigint>>"))
            .when(F.size(p["a"]) == F.size(p["b"]), F.transform(p["a"], lambda x, j: F.struct(s.alias("slot"), x.alias("a"), F.get(p["b"], j).alias("b"))))
            .otherwise(F.array(F.struct(s.alias("slot"), F.xxhash64(p["a"]).alias("a"), F.xxhash64(p["b"]).alias("b"))))
        ))

    return F.flatten(F.transform("slot", pairs))


class Decontaminator:
    """Leaks of a benchmark (item_id, text) in documents (doc_id, text).

    Null and blank texts have no windows, in either table; repeated rows add nothing (a leak is a pair of doc_id and item_id;
    rows with one doc_id are one document); a row with a null doc_id is a document of its own; very long texts are taken whole; other
    columns are ignored; with an empty table there are no leaks.
    """

    def __init__(self, spark: SparkSession, width: int = 8, cover: float = 0.6, literal: int = 4, small: int = 32 << 20, near: int = 4):
        self.spark, self.width, self.cover, self.literal, self.small, self.near = spark, width, cover, literal, small, near
        self.tmp = Scratch(spark, "benchmark")

    def index(self, benchmark: DataFrame) -> tuple[DataFrame, list[int], list[int]]:
        items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
        raw = _tokens(F.col("text"))
        slots = F.transform(raw, lambda x, i: F.struct(_slot(raw, x, i).alias("slot")))
        sized = items.withColumn("n", F.least(F.size(raw), F.lit(self.width))).withColumn("m", F.least(F.size(let(slots, _places)), F.lit(self.width)))
        sizes = sorted((r.n, r.m) for r in sized.select("n", "m").where("n > 0").distinct().collect()) or [(self.width, self.width)]
        parts = [windows(sized.where((F.col("n") == n) & (F.col("m") == m)), ["item_id"], [n], [m]) for n, m in sizes]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        words = F.size(F.filter("slot", lambda s: s == 0))
        out = out.withColumn("rich", (words >= F.least(F.lit(self.literal), F.col("size"))))
        total = out.groupBy("item_id", "literal").agg(F.countDistinct(F.when(F.col("rich"), F.col("at"))).alias("rich_n"), F.countDistinct("at").alias("all_n"))
        out = out.join(total, ["item_id", "literal"]).where("rich or (literal and rich_n = 0)")
        out = out.withColumn("nth", F.dense_rank().over(Window.partitionBy("item_id", "literal").orderBy("at")))
        of = F.when(F.col("rich_n") > 0, F.col("rich_n")).otherwise(F.col("all_n")).alias("of")
        out = out.select("item_id", "literal", "h", F.col("at").alias("item_at"), "nth", "slot", F.col("own").alias("item_own"), F.col("starts").alias("item_starts"), of).dropDuplicates(["item_id", "item_at", "h"])
        out = self.tmp.save("index", out)
        return out, sorted({n for n, _ in sizes}), sorted({m for _, m in sizes})

    def leaks(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """doc_id, item_id, windows that meet, word for word or not, of how many, and whether the slots are consistent."""
        leak = self._leaks(docs, benchmark)
        best = F.max(F.struct(F.size("same").alias("verbatim"), F.size("met").alias("met"), "of")).alias("best")
        return leak.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.met").cast("long").alias("n_windows"), F.col("best.verbatim").cast("long").alias("n_verbatim"), F.col("best.of").alias("n_item_windows"), F.lit(True).alias("consistent"))

    @staticmethod
    def _named(docs: DataFrame) -> list[Column]:
        """doc_id, and what tells documents with a null doc_id apart: a hash of their text."""
        doc_id = F.col("doc_id").cast("long")
        return [doc_id.alias("doc_id"), F.when(doc_id.isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0)).alias("twin")]

    def _leaks(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """Alignments that are leaks: doc_id, twin, item_id, the windows met (met, same) and of how many."""
        index, sizes, typed_sizes = self.index(benchmark)
        word, bit = place(F.col("h"))
        found = index.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.collect_set("bit").alias("bits")).collect()
        marks = [0] * (PLACES // 64)
        for r in found:
            value = sum(1 << b for b in r.bits)
            marks[r.word] = value - (1 << 64) if value >> 63 else value
        words = F.coalesce(F.size("item_own"), F.lit(0)) + F.coalesce(F.size("item_starts"), F.lit(0)) + F.size("slot")
        if (index.agg(F.sum(8 * words + 100)).first()[0] or 0) <= self.small:
            index = F.broadcast(index)
        texts = docs.select(*self._named(docs), F.col("text").cast("string").alias("text"))
        hits = windows(texts, ["doc_id", "twin"], sizes, typed_sizes, marks).drop("size", "slot", "literal").join(index, "h")
        met = F.struct(F.col("item_at").alias("at"), "nth")
        one = (
            hits.select("doc_id", "twin", "item_id", "literal", (F.col("at") - F.col("item_at")).alias("shift"), "of", met.alias("met"), (F.col("literal") | (F.col("own") == F.col("item_own"))).alias("same"), _filled().alias("slots"))
            .groupBy("doc_id", "twin", "item_id", "literal", "shift")
            .agg(
                F.collect_set("met").alias("met"),
                F.collect_set(F.when(F.col("same"), F.col("met"))).alias("same"),
                F.first("of").alias("of"),
                F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
            )
        )
        one = one.where(self._consistent())
        # Neighbouring offsets are one alignment: a word more or less in the middle moves what follows.
        ordered = Window.partitionBy("doc_id", "twin", "item_id", "literal").orderBy("shift")
        far = F.coalesce(F.col("shift") - F.lag("shift").over(ordered) > self.near, F.lit(True))
        joined = (
            one.withColumn("far", far.cast("int"))
            .withColumn("group", F.sum("far").over(ordered))
            .groupBy("doc_id", "twin", "item_id", "literal", "group")
            .agg(
                F.first("of").alias("of"),
                F.collect_list(F.struct("met", "same")).alias("alone"),
                F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"),
                F.array_distinct(F.flatten(F.collect_list("same"))).alias("same"),
                F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
            )
        )
        # Each offset alone and all together, from one pass over the documents.
        both = F.when(self._consistent(), F.concat("alone", F.array(F.struct("met", "same")))).otherwise(F.col("alone"))
        judged = joined.select("doc_id", "twin", "item_id", "of", F.inline(both))
        return judged.where(F.size("met") + self._broken() >= F.col("of") * self.cover)

    @staticmethod
    def _consistent() -> Column:
        sided = lambda side: F.size(F.array_distinct(F.transform("slots", lambda p: F.struct(p["slot"], p[side]))))
        return (sided("a") == F.size("slots")) & (sided("b") == F.size("slots"))

    def _broken(self) -> Column:
        """How many of the item's windows lie between two that meet and are broken by an edit of at most ``near`` words."""

        def between(met: Column) -> Column:
            gap = F.transform(met, lambda x, i: F.when((i > 0) & (x["at"] - F.get(met, i - 1)["at"] < self.width + self.near + 1), x["nth"] - F.get(met, i - 1)["nth"] - 1).otherwise(0))
            return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

        return let(F.sort_array("met"), between)

    def clean(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """``docs`` without the documents that leak an item; all columns stay."""
        gone = self._leaks(docs, benchmark).select(F.col("doc_id").alias("__leak"), F.col("twin").alias("__twin")).distinct()
        doc_id, twin = self._named(docs)
        return docs.join(gone, doc_id.eqNullSafe(gone["__leak"]) & (twin == gone["__twin"]), "left_anti")
