"""Secret scans over a content-addressed ledger, in DataFrame expressions only.

Every version of every text is a blob named by its SHA-256. The ledger holds one row for each blob and version of the rules that has
been scanned, with its findings. A run adds what is missing: it takes the distinct blobs, leaves out those
in the ledger, scans the rest once and appends them; findings are then joined back to every path of a blob.

A scan splits the text at a rule's matches; the lengths of the pieces and of the matches give the places. Spans are in code
points, the end exclusive. Only texts that hold a rule's marker leave the map side, so the shuffle carries blob names and
few texts. A blob that a third of all rows share is reduced before the shuffle, and the join back is on plain columns,
which adaptive execution splits.

Null texts are empty; an empty text has no spans; repeated rows come out as often as they went in; other columns are
ignored or, by ``redact``, kept; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, free_name, let, running

_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, leftmost and without overlap; a match is kept if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    markers: tuple[str, ...] = ()


#: The base kinds in their order, then the kinds that this method adds.
BASE = (
    Rule("assign", f"(?i:{_KEY})", 2, 6, ("password", "passwd", "secret", "token", "api")),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("-----begin ",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, ("eyj",)),
    Rule("hub", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE + ADDED
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def version(rules: tuple[Rule, ...]) -> str:
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def run_pattern(rule: Rule) -> tuple[str, bool]:
    """The pattern to search, and whether its matches need no further test: a run is taken whole, so one that is too short can be left out."""
    if rule.group or rule.least == 1:
        return rule.pattern, rule.least == 1
    fixed = len("AKIA") if rule.pattern.startswith("AKIA") else 0
    return f"{rule.pattern[:-1]}{{{rule.least - fixed},}}", True


def found(text: Column, low: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in a text; ``low`` is the text in lower case."""
    pattern, whole = run_pattern(rule)
    keep = None if whole else rule
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("pieces"))

    def walk(p: Column) -> Column:
        # Match k ends where all pieces and matches up to it do.
        kind = lambda m: F.when(F.length(F.regexp_extract(m, keep.pattern, keep.group)) >= keep.least, rule.kind) if keep else F.lit(rule.kind)
        ends = running(F.transform(p["match"], lambda m, k: F.length(F.get(p["pieces"], k)) + F.length(m)))
        return let(ends, lambda e: F.transform(p["match"], lambda m, k: F.struct((F.get(e, k) - F.length(m)).alias("start"), F.lit(rank).alias("rank"), kind(m).alias("kind"), F.get(e, k).alias("end"))))

    spans = F.filter(let(both, walk), lambda s: s["kind"].isNotNull())
    return F.when(marked(text, low, rule), spans).otherwise(F.array().cast(SPAN))


def marked(text: Column, low: Column, rule: Rule) -> Column:
    """A cheap test that every text with a match passes."""
    if not rule.markers:
        return text.rlike(f"{rule.pattern[:-1]}{{{rule.least}}}")
    test = F.contains(low, F.lit(rule.markers[0]))
    for m in rule.markers[1:]:
        test = test | F.contains(low, F.lit(m))
    return test


class SecretScan:
    """See the module's text. ``ledger`` is the folder of a ledger to extend; without one, the run has a ledger of its own."""

    def __init__(self, spark: SparkSession, rules: tuple[Rule, ...] = RULES, ledger: str | None = None):
        self.spark, self.rules, self.version = spark, rules, version(rules)
        self.tmp = Scratch(spark, "secrets")
        self.ledger, self.fresh = ledger or self.tmp.path("ledger"), ledger is None

    schema = f"blob binary, rules string, spans {SPAN}"

    def known(self) -> DataFrame:
        """The ledger as it is; empty before the first run."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.ledger)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(self.schema).parquet(self.ledger) if there else self.spark.createDataFrame([], self.schema)

    def scan(self, texts: DataFrame) -> DataFrame:
        """Adds the blobs of ``texts`` (blob, text) that the ledger lacks under these rules; returns the ledger's rows for these rules."""
        low = F.lower("text")
        marks = [marked(F.col("text"), F.col("low"), r) for r in self.rules]
        some = marks[0]
        for m in marks[1:]:
            some = some | m
        rows = texts
        if not self.fresh:
            have = self.known().where(F.col("rules") == self.version).select("blob").distinct()
            rows = rows.join(have, "blob", "left_anti")
        rows = rows.withColumn("low", low).select("blob", F.when(some, F.col("text")).alias("text"))
        # Texts of one blob are equal, so any of them does; most blobs bring a null.
        rows = rows.groupBy("blob").agg(F.max("text").alias("text")).withColumn("low", low)
        empty = F.array().cast(SPAN)
        spans = F.concat(*[found(F.col("text"), F.col("low"), r, k) for k, r in enumerate(self.rules)])
        rows.select("blob", F.lit(self.version).alias("rules"), F.when(F.col("text").isNull(), empty).otherwise(F.array_sort(spans)).cast(SPAN).alias("spans")).write.mode("append").parquet(self.ledger)
        return self.known().where(F.col("rules") == self.version).select("blob", "spans")

    def run(self, docs: DataFrame, name: str = "__spans") -> DataFrame:
        """Every row of ``docs`` with its spans under a ``name`` that is free: of all kinds, by start, then in the order of the rules."""
        text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), free_name(docs, "__blob")
        blob = F.unhex(F.sha2(text.cast("binary"), 256))
        ledger = self.scan(docs.select(blob.alias("blob"), text.alias("text")))
        # A ledger extended by two runs at once may hold a blob twice, with equal spans.
        ledger = ledger if self.fresh else ledger.groupBy("blob").agg(F.max("spans").alias("spans"))
        hits = ledger.where(F.size("spans") > 0).select(F.col("blob").alias(key), F.col("spans").alias(name))
        return docs.withColumn(key, blob).join(hits, key, "left").withColumn(name, F.coalesce(name, F.array().cast(SPAN))).drop(key)


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    rows = SecretScan(spark, rules, ledger).run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.filter("__spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("__spans", lambda s: s["rank"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("__spans")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span, or run of overlapping spans, of its texts replaced; all columns and rows stay."""
    name = free_name(docs, "__spans")
    rows = SecretScan(spark).run(docs, name)
    text, spans = F.col("text"), F.col(name)
    # Spans come by start: each keeps what lies between it and the furthest end before it.
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)

    def masked(end: Column) -> Column:
        def piece(s: Column, k: Column) -> Column:
            at = F.coalesce(F.get(end, k - 1), F.lit(0))
            return F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mask))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, F.element_at(end, -1) + 1, F.length(text)))

    walk = let(ends, masked)
    return rows.withColumn("text", F.when(F.size(spans) > 0, walk).otherwise(text)).select(*docs.columns)
