"""Personal data by candidate gradient boosting, in DataFrame functions only.

Exact format rules give the base spans. Wide, high-recall generators propose further (overlapping) spans;
boosted trees, fitted on a bounded sample with the base spans as weak labels, score format and context
features, and a threshold calibrated for precision on held-out candidates selects what is added.
Fitted trees become CASE expressions, so scoring is one projection: no shuffle, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.llm.shared import stored, table

KINDS = ("email", "ip", "card", "phone")
# Each pattern finds what its plain form finds, in linear time: runs start at their first character
# (a mid-run start can match only what a first start would have matched longer), and loops are possessive.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
WIDE_NUMBER = r"(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){7,}+"
WIDE_MAIL = r"(?<![^\s@])[^\s@]++@[^\s@]++"
WIDE_AT = rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
CONTEXT = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|account|ip|host|server|address)[^A-Za-z]{0,6}$"
BLOCK = 128

FEATURES = (
    "digits", "chars", "separators", "dots", "plus", "at", "letters", "dashes", "parens", "alnum_before", "alnum_after",
    "context", "domain_dots", "luhn",
)


def prefix_sums(values: Column) -> Column:
    """Running totals of an array column, by blocks so that long arrays stay near linear."""
    n, zero = F.size(values), F.lit(0).cast("long")
    blocks = F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1)

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, x: acc + x)

    sums = F.transform(blocks, lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))

    def inside(before: Column, b: Column) -> Column:
        part = F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
        return F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: before + total(F.slice(part, F.lit(1), i)))

    def with_offset(b: Column) -> Column:
        before = F.transform(F.array(total(F.slice(sums, F.lit(1), b))), lambda x: x)
        return F.flatten(F.transform(before, lambda x: inside(x, b)))

    return F.when(n > 0, F.flatten(F.transform(blocks, with_offset))).otherwise(F.array().cast("array<bigint>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _find(docs: DataFrame) -> DataFrame:
    """Per document: base spans by kind, and the candidates of the wide generators with their context."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_at = F.contains(text, F.lit("@"))
    plan = {
        "email": (EMAIL, has_at),
        "ip": (IP, F.contains(text, F.lit("."))),
        "card": (CARD, F.length(text) >= 14),
        "phone": (PHONE, F.contains(text, F.lit("+"))),
        "w_number": (WIDE_NUMBER, F.length(text) >= 8),
        "w_mail": (WIDE_MAIL, has_at),
        "w_at": (WIDE_AT, F.contains(F.lower(text), F.lit("at)")) | F.contains(F.lower(text), F.lit("at]"))),
    }
    none = F.array().cast("array<string>")
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.when(on, F.split(text, p, -1)).otherwise(none).alias(f"{k}_p") for k, (p, on) in plan.items()],
        *[F.when(on, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"{k}_m") for k, (p, on) in plan.items()],
    )

    def gaps(k: str) -> Column:
        """From the end of the match before to the start of each match, the match before included."""
        before = F.transform(F.col(f"{k}_p"), lambda x: F.length(x).cast("long"))
        own = F.transform(F.col(f"{k}_m"), lambda x: F.length(x).cast("long"))
        both = F.zip_with(before, F.concat(F.array(F.lit(0).cast("long")), own), lambda a, b: a + b)
        return F.slice(both, F.lit(1), F.size(F.col(f"{k}_m")))

    cut = cut.withColumns({f"{k}_g": gaps(k) for k in plan})
    cut = cut.withColumns({f"{k}_s": prefix_sums(F.col(f"{k}_g")) for k in plan})

    def base(k: str) -> Column:
        spans = F.zip_with(
            F.col(f"{k}_m"),
            F.col(f"{k}_s"),
            lambda m, s: F.struct(s.alias("s"), F.lit(KINDS.index(k)).alias("k"), (s + F.length(m)).alias("e"), m.alias("m")),
        )
        return F.filter(spans, lambda x: _valid(k, x["m"]))

    def wide(k: str) -> Column:
        n = F.size(f"{k}_m")
        around = F.zip_with(
            F.slice(f"{k}_p", F.lit(1), n),
            F.slice(f"{k}_p", F.lit(2), n),
            lambda b, a: F.struct(F.substring(b, -24, 24).alias("b"), F.substring(a, 1, 1).alias("a")),
        )
        spans = F.zip_with(F.col(f"{k}_m"), F.col(f"{k}_s"), lambda m, s: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))
        return F.zip_with(
            spans, around, lambda x, y: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), y["b"].alias("b"), y["a"].alias("a"))
        )

    return cut.select(
        "doc_id",
        *[base(k).alias(k) for k in KINDS],
        F.concat(*[wide(k) for k in plan if k.startswith("w_")]).alias("wide"),
    )


def _features(c: Column) -> Column:
    """Format and context of a candidate, as one struct of doubles."""
    m, d = c["m"], _digits(c["m"])
    count = lambda pattern: F.length(m) - F.length(F.regexp_replace(m, pattern, ""))
    values = {
        "digits": F.length(d),
        "chars": F.length(m),
        "separators": count(r"[\x20().-]"),
        "dots": count(r"\."),
        "plus": F.startswith(m, F.lit("+")),
        "at": F.contains(m, F.lit("@")),
        "letters": count("[A-Za-z]"),
        "dashes": count("-"),
        "parens": count(r"[()]"),
        "alnum_before": c["b"].rlike(r"[A-Za-z0-9]$"),
        "alnum_after": c["a"].rlike(r"[A-Za-z0-9]"),
        "context": c["b"].rlike(CONTEXT),
        "domain_dots": F.length(F.regexp_replace(F.substring_index(m, "@", -1), r"[^.]", "")),
        "luhn": (F.length(d) >= 12) & (F.length(d) <= 19) & luhn(d),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def _kind(f: Column) -> Column:
    """The kind of an added span, as its place in KINDS."""
    return (
        F.when((f["at"] > 0) | (f["letters"] > 0), 0)
        .when((f["dots"] == 3) & (f["separators"] == 3) & (f["digits"] <= 12), 1)
        .when((f["plus"] == 0) & (f["parens"] == 0) & (f["digits"] >= 13), 2)
        .otherwise(3)
    )


@dataclass
class Boosted:
    """Trees as (weight, nested tuples) and the score from which a candidate is redacted."""

    trees: list[tuple[float, tuple]]
    threshold: float

    def score(self, f: Column) -> Column:
        def walk(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(node[0])
            name, bound, low, high = node
            return F.when(f[name] <= F.lit(bound), walk(low)).otherwise(walk(high))

        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * walk(root)
        return total


def _nodes(node) -> tuple:
    if node.subtreeDepth() == 0:
        return (float(node.prediction()),)
    split = node.split()
    return (FEATURES[split.featureIndex()], float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild()))


def fit(docs: DataFrame, precision: float = 0.98, trees: int = 8, depth: int = 3) -> Boosted:
    """Fits on the candidates of all documents that have an id, a third of these kept to calibrate.

    Candidates of one description and label are one row with their number. The threshold is the least score at which
    held-out candidates reach the precision. Without candidates of both labels nothing is added: the threshold is infinite.
    """
    found = _find(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"))
    spans = found.select("doc_id", F.concat(*KINDS).alias("base"), "wide")
    rows = spans.select(
        "doc_id",
        F.explode(
            F.transform(
                "wide",
                lambda c: F.struct(
                    _features(c).alias("f"),
                    F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])).cast("double").alias("label"),
                ),
            )
        ).alias("c"),
    ).select("doc_id", "c.label", "c.f.*")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0
    rows = rows.withColumn("held", held).groupBy("held", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = stored(rows, "pii-candidates")
    labels = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}
    if len(labels) < 4:
        return Boosted([], math.inf)
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.filter(~F.col("held")))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=0.3, weightCol="n").fit(train.select("label", "features", "n"))
    boosted = Boosted([(float(w), _nodes(t._call_java("rootNode"))) for t, w in zip(model.trees, model.treeWeights)], math.inf)
    scored = rows.filter("held").select("label", "n", boosted.score(F.struct(*FEATURES)).alias("score"))
    by_score = scored.groupBy("score").agg(F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("n").alias("n"))
    down = Window.orderBy(F.col("score").desc())
    ok = by_score.select("score", F.sum("hits").over(down).alias("hits"), F.sum("n").over(down).alias("n")).filter(F.col("hits") >= precision * F.col("n"))
    least = ok.agg(F.min("score")).first()[0]
    return Boosted(boosted.trees, math.inf if least is None else float(least))


def find_pii(docs: DataFrame, model: Boosted) -> DataFrame:
    """One row per document: doc_id, n_<kind> of the base spans, base_spans and spans as arrays of (s, k, e).

    A null text counts as empty and has no spans; ids may be null or repeat; other columns are ignored.
    """
    found = _find(docs)
    scored = F.transform("wide", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), _features(c).alias("f")))
    found = found.withColumn("scored", scored)
    keep = F.filter("scored", lambda c: model.score(c["f"]) >= F.lit(model.threshold))
    if math.isinf(model.threshold):
        keep = F.slice("scored", F.lit(1), F.lit(0))
    plain = "array<struct<s:bigint,k:int,e:bigint>>"
    spans = F.transform(F.concat(*KINDS), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).cast(plain)
    more = F.transform(keep, lambda c: F.struct(c["s"].alias("s"), _kind(c["f"]).alias("k"), c["e"].alias("e"))).cast(plain)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.array_sort(spans).alias("base_spans"),
        F.array_sort(F.concat(spans, more)).alias("spans"),
    )


def _written(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    tags = F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"]))
    return F.array_join(F.array_distinct(tags), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fit(docs))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(_written("base_spans"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
    )


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; ids must be unique here.

    Overlapping spans are merged under the kind of the first. Documents without spans are unchanged.
    """
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<s:bigint,k:int,e:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["s"] < F.element_at(acc, -1)["e"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.element_at(acc, -1)["k"].alias("k"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    part = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    built = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["out"], part(acc["at"], x["s"]), F.get(kinds, x["k"])).alias("out"), x["e"].alias("at")
        ),
        lambda acc: F.concat(acc["out"], part(acc["at"], F.length("text").cast("long"))),
    )
    joined = docs.join(found.select("doc_id", merged.alias("spans")), "doc_id", "left")
    redacted = F.when(F.size("spans") > 0, built).otherwise(F.col("text"))
    return joined.withColumn("text", redacted).select(*docs.columns)


QUERIES = {"op1_pii": op1_pii}
