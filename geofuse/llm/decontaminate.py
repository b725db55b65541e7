"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over SPAN words that looks at four of them and ignores one. Hashes of the masked words of
the benchmark are joined to those of every document, and of what meets the item is laid over the document wherever a
seed of both agrees, and compared word by word. Of a passage that keeps four fifths of an item's words in place,
some span of five has at most one word changed, so one of the masks always hits it: no such overlap is lost.

The benchmark may be of any size: its seeds are a table. Only a bit map of bounded size, the union of their hashes, goes to
every task, so that a document's seeds are dropped where they are made unless they may be in the benchmark.

A sentence that many documents and items share would make a pair of each with each. So an item's places are ordered by
how many texts hit them, and the commonest are left out of the index, as many as could not make up the least overlap by
themselves (prefix filter): a text that hits no other place doesn't contain the item. Left are pairs of texts and items
that share a rarer place, or so much of the item that the overlap must be measured.
Work goes by distinct text (128 bits of its digest); a text is sent once to be laid under some items at once.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.llm.shared import discard, per_salt, salt_of, small_batches, stored, table

SPAN = 5
MASKS = ((0, 1, 2, 3), (1, 2, 3, 4), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
SPACED = bytes.maketrans((string.punctuation + "".join(map(chr, range(32)))).encode(), b" " * (len(string.punctuation) + 32))
#: The bit map has 64 bits a seed or more (of seeds that the benchmark lacks, one in 64 passes), and 2 to the power of so many bits at most: 64 MB, the bound of what is broadcast.
MAP_BITS = (20, 29)
#: Items that a text is compared with at once, on average at most.
ITEMS = 64
#: Hits whose keys go to every task, at most; more are joined by shuffle.
TOLD = 200_000
SPREAD = 16
#: Diagonals that are compared at once, times the words of the item.
AREA = 1 << 17
c = F.col


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words, ASCII punctuation taken as white space."""
    return (text or "").lower().encode("utf-8", "replace").translate(SPACED).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", len(words))


def seed_hashes(words: np.ndarray, offsets: tuple[int, ...], span: int) -> np.ndarray:
    """The hash at each position of the words at those offsets; different for each mask."""
    n = len(words) - span + 1
    h = np.full(max(n, 0), xxhash.xxh64_intdigest(bytes((span, *offsets))), "uint64")
    for o in offsets if n > 0 else ():
        h = (h ^ words[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def seeds(words: np.ndarray, short: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """Seeds by mask; for items of so few words that no mask fits, of all runs of their lengths."""
    for mask in MASKS:
        yield seed_hashes(words, mask, SPAN)
    for n in short:
        yield seed_hashes(words, tuple(range(n)), n)


def ordered_seeds(doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By mask, the places of a document's seeds in the order of their hashes, and these."""
    orders = [(np.argsort(a, kind="stable"), a) for a in seeds(doc)]
    return [(order, a[order]) for order, a in orders]


def diagonals(doc: np.ndarray, item: np.ndarray, ordered: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """Where a seed of both agrees: the places of the item's first word in the document, whose seeds may be given in order."""
    m, near = len(item), np.zeros(len(doc) + len(item), bool)
    for (order, found), b in zip(ordered or ordered_seeds(doc), seeds(item)):
        lo, hi = np.searchsorted(found, b, "left"), np.searchsorted(found, b, "right")
        for place in np.flatnonzero(hi > lo):
            near[order[lo[place] : hi[place]] - place + m] = True
    return np.flatnonzero(near) - m


def overlap(item: np.ndarray, doc: np.ndarray, at: np.ndarray, least: float) -> float:
    """The share of the item's words that are in place.

    The item is laid over the document at each diagonal. It is the best diagonal's share, or, where words were
    put in or left out, that of all together; then only words in spans of which least is in place count.
    """
    n = len(item)
    padded = np.concatenate([np.zeros(n, "uint64"), doc, np.zeros(n, "uint64")])
    inside = np.concatenate([np.zeros(n, bool), np.ones(len(doc), bool), np.zeros(n, bool)])
    windows, present = (np.lib.stride_tricks.sliding_window_view(x, n) for x in (padded, inside))
    best, covered, step = 0.0, np.zeros(n, bool), max(1, AREA // n)
    for k in range(0, len(at), step):
        rows = at[k : k + step] + n
        same = (windows[rows] == item) & present[rows]
        best = max(best, float(same.mean(axis=1).max()))
        sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1, dtype="int32")
        spans = sums[:, SPAN:] - sums[:, :-SPAN] >= SPAN * least
        near = np.zeros_like(same)
        for o in range(SPAN):
            near[:, o : o + spans.shape[1]] |= spans
        covered |= (same & near).any(axis=0)
    return max(best, float(covered.mean()))


def shares(doc: list[bytes], items: list[list[bytes]], least: float) -> list[float]:
    """Of items of five words or more the overlap; a shorter one counts where all its words stand in a row."""
    h, out = hashed(doc), []
    ordered = ordered_seeds(h) if any(len(item) >= SPAN for item in items) else None
    for item in items:
        if not item or not doc:
            out.append(0.0)
        elif len(item) < SPAN:
            out.append(float(any(doc[i : i + len(item)] == item for i in range(len(doc) - len(item) + 1))))
        else:
            own = hashed(item)
            at = diagonals(h, own, ordered)
            out.append(overlap(own, h, at, least) if len(at) else 0.0)
    return out


def share(doc: list[bytes], item: list[bytes], least: float) -> float:
    return shares(doc, [item], least)[0]


def out_of_place(hit: np.ndarray) -> int:
    """The fewest words out of place on a diagonal where of the item's spans only those hit have four words in place.

    Every other span then has two words or more that differ. From left to right they are put as far right as a span that
    lacks them allows, where they serve the most spans to come.
    """
    n, before, last = 0, -1, -1
    for p in np.flatnonzero(~hit).tolist():
        if last < p:
            n, before, last = n + 2, p + SPAN - 2, p + SPAN - 1
        elif before < p:
            n, before, last = n + 1, last, p + SPAN - 1
    return n


def may_suffice(hit: np.ndarray, least: float) -> bool:
    """False only if no text that hits an item at those places alone has the least overlap with it."""
    n = len(hit) + SPAN - 1
    covered = int((np.convolve(hit, np.ones(SPAN, "int64")) > 0).sum())
    return max(covered, n - out_of_place(hit)) >= least * n - 1e-9


def rarest(n: int, places: np.ndarray, texts: np.ndarray, least: float) -> np.ndarray:
    """Which of an item's places that texts hit are its index: all but the commonest, as long as those can't suffice."""
    order = np.lexsort((places, -texts))

    def suffices(first: int) -> bool:
        hit = np.zeros(n - SPAN + 1, bool)
        hit[places[order[:first]]] = True
        return may_suffice(hit, least)

    low, high = 0, len(order) + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if suffices(middle) else (middle, high)
    return order[low:]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view("int64")


def _digest(*parts) -> Column:
    """128 bits of texts and ids; null where one is null."""
    return F.unhex(F.md5(F.concat(*[F.concat(x.cast("string"), F.lit("\n")) for x in parts[:-1]], parts[-1].cast("string")).cast("binary")))


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """i (key), item_id, item (its text), n (words) and seeds (hash and place) of each item that has an id and words."""

    @F.pandas_udf("n int, h array<long>, p array<int>")
    def own(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            h = hashed(tokens(text))
            some = list(seeds(h)) if len(h) >= SPAN else [seed_hashes(h, tuple(range(len(h))), len(h))]
            out.append((len(h), _signed(np.concatenate(some)), np.concatenate([np.arange(len(x), dtype="int32") for x in some])))
        return pd.DataFrame(out, columns=["n", "h", "p"]).astype({"n": "int32"})

    items = benchmark.select(c("item_id").cast("long").alias("item_id"), c("text").cast("string").alias("item")).filter("item_id IS NOT NULL").distinct()
    found = items.withColumn("s", own("item")).filter("s.n > 0")
    return stored(found.select(_digest(c("item_id"), c("item")).alias("i"), "item_id", "item", "s.n", F.arrays_zip("s.h", "s.p").alias("seeds")), "decontam-items")


def map_bits(items: DataFrame) -> int:
    """The size of the bit map, by the benchmark's."""
    n = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    return min(MAP_BITS[1], max(MAP_BITS[0], int(64 * n).bit_length()))


def bit_map(items: DataFrame, bits: int) -> np.ndarray:
    """The union of the seeds' leading bits, packed; at most 2 ** (bits - 6) words reach the driver."""
    bucket = F.shiftrightunsigned(c("h"), 64 - bits)
    words = items.select(F.explode("seeds.h").alias("h")).groupBy(F.shiftright(bucket, 6).alias("w"))
    rows = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bucket.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toPandas()
    out = np.zeros(1 << bits - 6, "int64")
    out[rows["w"].to_numpy("int64")] = rows["b"].to_numpy("int64")
    return out.astype("<i8").view("uint8")


def _candidates(spark: SparkSession, items: DataFrame):
    """The seeds of a text that may be in the benchmark, each once."""
    short = tuple(sorted(r["n"] for r in items.filter(c("n") < SPAN).select("n").distinct().collect()))
    size = map_bits(items)
    shared = spark.sparkContext.broadcast((bit_map(items, size), short))

    @F.pandas_udf("array<long>")
    def found(texts: pd.Series) -> pd.Series:
        bits, lengths = shared.value
        out = []
        for text in texts:
            parts = []
            for h in seeds(hashed(tokens(text)), lengths):
                at = h >> np.uint64(64 - size)
                parts.append(h[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("uint8") & 1).astype(bool)])
            out.append(_signed(np.unique(np.concatenate(parts))))
        return pd.Series(out, dtype=object)

    return found(c("text").cast("string"))


HITS = "array<struct<item_id:bigint,overlap:double>>"


def index(items: DataFrame, hits: DataFrame, least: float) -> DataFrame:
    """i and h: seeds of each item of which a text that contains it has one (items of few words have one seed)."""

    @F.pandas_udf("array<long>")
    def kept(words: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for n, rows in zip(words, places):
            p, texts = np.array([r["p"] for r in rows]), np.array([r["texts"] for r in rows])
            some = rarest(n, p, texts, least) if n >= SPAN else range(len(rows))
            out.append(np.unique(np.concatenate([np.zeros(0, "int64"), *[rows[x]["h"] for x in some]])).astype("int64"))
        return pd.Series(out, dtype=object)

    met = hits.groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
    places = items.select("i", "n", F.inline("seeds")).join(met, "h").groupBy("i", "n", "p").agg(F.sum("texts").alias("texts"), F.collect_set("h").alias("h"))
    by_item = places.groupBy("i", "n").agg(F.collect_list(F.struct("p", "texts", "h")).alias("places"))
    return by_item.select("i", F.explode(kept("n", "places")).alias("h"))


def text_seeds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """k (digest of a text) and h: its seeds that may be in the benchmark.

    The digest comes before the explode: beside it, a text would be digested anew for each of its seeds. An outer explode, since
    of another Spark infers a filter of the texts without seeds, for which all would be made twice.
    """
    own = docs.select(_digest(c("text")).alias("k"), _candidates(docs.sparkSession, items).alias("own"))
    return own.select("k", F.explode_outer("own").alias("h")).filter("h IS NOT NULL").distinct()


def candidates(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """k (digest of a text) and i of the pairs to be measured: all with the least overlap are among them."""
    hits = stored(text_seeds(docs, items).join(items.select(F.explode("seeds.h").alias("h")).distinct(), "h", "left_semi"), "decontam-hits")
    pairs = stored(hits.join(index(items, hits, least), "h").select("k", "i").distinct(), "decontam-pairs")
    discard(hits)
    return pairs


def found_items(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """k (digest of a text) and items (array of item_id and overlap, by item_id) of the texts that contain any."""
    small_batches(docs.sparkSession)
    items = item_seeds(benchmark)
    pairs = candidates(docs, items, least)
    keys = stored(pairs.groupBy("k").agg(F.count(F.lit(1)).alias("m")), "decontam-keys")
    text = docs.select(_digest(c("text")).alias("k"), c("text").cast("string").alias("text"))
    hit = text.join(F.broadcast(keys.select("k")) if keys.count() <= TOLD else keys.select("k"), "k", "left_semi")
    once = hit.groupBy("k").agg(F.any_value("text").alias("text"))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([shares(tokens(t), [tokens(i) for i in some], least) for t, some in zip(texts, own)], dtype=object)

    part = F.pmod(F.xxhash64("i"), F.ceil(c("m") / ITEMS)).alias("part")
    parts = pairs.join(keys, "k").join(items.select("i", "item_id", "item"), "i").groupBy("k", part).agg(F.collect_list(F.struct("item_id", "item")).alias("some"))
    both = parts.join(once, "k").withColumn("overlap", measured("text", "some.item"))
    each = both.select("k", F.inline(F.arrays_zip(c("some.item_id").alias("item_id"), c("overlap").alias("overlap"))))
    kept = each.filter(c("overlap") >= least).distinct()
    found = stored(kept.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("item_id", "overlap"))).cast(HITS).alias("items")), "decontam-found")
    discard(items, pairs, keys)
    return found


def _spread(found: DataFrame) -> DataFrame:
    """A row for each of the salts over which a text's copies are spread."""
    return per_salt(found.withColumn("salts", F.lit((1 << SPREAD) - 1).cast("long")))


def _salt(docs: DataFrame):
    return salt_of(c("doc_id"), salts=SPREAD)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, contaminated, items (array of item_id and overlap, by item_id).

    Null and blank texts are clean; null and blank items, and items without an id, match nothing. Ids of
    documents may be null or repeat; of items that share an id each may match. An item of fewer than five words counts
    where all its words stand in a row. An empty benchmark leaves all clean. Other columns are ignored.
    """
    found = found_items(docs, benchmark, least)
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), _digest(c("text")).alias("k"), _salt(docs).alias("salt"))
    out = rows.join(_spread(found), ["k", "salt"], "left").select("doc_id", F.coalesce("items", F.array().cast(HITS)).alias("items"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """docs' own rows that contain no item."""
    found = found_items(docs, benchmark, least)
    few = found.count() <= TOLD
    rows = docs.select(F.struct(*docs.columns).alias("doc"), _digest(c("text")).alias("k"), _salt(docs).alias("salt"))
    keys = F.broadcast(found.select("k")) if few else _spread(found).select("k", "salt")
    return rows.join(keys, ["k"] if few else ["k", "salt"], "left_anti").select("doc.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "contaminated",
        F.transform("items", lambda x: x["item_id"]).alias("item_ids"),
        F.round(F.array_max(F.transform("items", lambda x: x["overlap"])), 6).alias("overlap"),
    )


QUERIES = {"op2_decontaminate": op2_decontaminate}
