"""Periodic runs of words, found on a grammar.

The word ids of some documents are put one after another and compressed by Re-Pair: adjacent pairs that occur more than
once become nonterminals, the commonest first. One round replaces every pair that is commoner than the pairs beside it
(ties by a hash), so there are about as many rounds as the logarithm of the text; what is left of each document is
folded into a balanced tree. A run lies across the boundary of exactly one lowest node, X -> Y Z. So for each
nonterminal, once, whatever the number of its occurrences, the runs across the boundary of Y and Z are computed: a run of
four periods has two of them on one side of it, where its words repeat at once; candidates are extended by comparing
prefix hashes. Runs are then translated to all places of the nonterminal's derivations, and intervals of one period
that overlap by a period or more are merged into the maximal one. Every run is compared word by word in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.llm.shared import small_batches, table

#: Words that are compressed together; a longer document stands alone. Comparisons that are held at once.
TOGETHER, AT_ONCE = 1 << 17, 1 << 20
PRIMES = (2147483647, 2147483629)
MINIMUM, EXPONENT = 6, 4
RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


class Grammar:
    """Rules over the words of some documents; symbols under n_words are words, rule r is symbol n_words + r.

    A rule has a left and a right symbol, their lengths, and a place of the text where it occurs. rounds are the numbers of
    rules after each round, roots the place and the symbol of each document that has words.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.n_words = int(words.max(initial=-1)) + 1
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rounds = [0]
        self.sym, self.at, self.size, self.doc = words.astype("int64"), np.arange(len(words)), np.ones(len(words), "int64"), doc
        self._pair()
        self._fold()
        self.left, self.right, self.start, self.lsize, self.rsize = (np.concatenate([p[i] for p in self.parts] or [np.zeros(0, "int64")]) for i in range(5))
        self.roots = self.at, self.sym

    def _replace(self, places: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Replaces the pairs at places by new symbols; number is each one's rule of this round, first a place of each rule."""
        a = places[first]
        self.parts.append((self.sym[a], self.sym[a + 1], self.at[a], self.size[a], self.size[a + 1]))
        self.sym[places] = self.n_words + self.rounds[-1] + number
        self.size[places] += self.size[places + 1]
        self.rounds.append(self.rounds[-1] + len(first))
        keep = np.ones(len(self.sym), bool)
        keep[places + 1] = False
        self.sym, self.at, self.size, self.doc = self.sym[keep], self.at[keep], self.size[keep], self.doc[keep]
        return keep

    def _pair(self) -> None:
        live = np.ones(len(self.sym), bool)
        while True:
            # Pairs that were alone stay alone until one of their symbols is new.
            i = np.flatnonzero(live[:-1] & (self.doc[:-1] == self.doc[1:]))
            key = self.sym[i] * (self.n_words + self.rounds[-1]) + self.sym[i + 1]
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(i) else np.zeros(0, "int64")
            count = np.diff(np.r_[heads, len(i)])
            n = np.empty(len(i), "int64")
            n[order] = np.repeat(count, count)
            i, key, n = i[n > 1], key[n > 1], n[n > 1]
            if not len(i):
                return
            hashed = key.view("uint64") * np.uint64(0x9E3779B97F4A7C15)
            weight = np.zeros(len(self.sym) + 1, "int64")
            weight[i + 1] = np.minimum(n, (1 << 31) - 1) << 32 | (hashed >> np.uint64(33)).view("int64")
            # Stretches of one weight, as of "a a a": every second pair of those that outweigh both neighbours.
            edge = np.flatnonzero(np.diff(weight)) + 1
            edge = np.r_[0, edge, len(weight)]
            w = weight[edge[:-1]]
            top = (w > 0) & (w > np.r_[0, w[:-1]]) & (w > np.r_[w[1:], 0])
            a, m = edge[:-1][top] - 1, (np.diff(edge)[top] + 1) // 2
            places = np.repeat(a, m) + 2 * (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
            _, first, number = np.unique(key[np.searchsorted(i, places)], return_index=True, return_inverse=True)
            live = np.zeros(len(self.sym), bool)
            live[i] = live[places] = live[np.maximum(places - 1, 0)] = True
            keep = self._replace(places, number, first)
            live = live[keep]

    def _fold(self) -> None:
        while True:
            head = np.flatnonzero(np.r_[True, np.diff(self.doc) != 0]) if len(self.doc) else np.zeros(0, "int64")
            nth = np.arange(len(self.doc)) - np.repeat(head, np.diff(np.r_[head, len(self.doc)]))
            places = np.flatnonzero((nth[:-1] % 2 == 0) & (nth[1:] > nth[:-1]))
            if not len(places):
                return
            own = np.arange(len(places))
            self._replace(places, own, own)


class Hashes:
    """Prefix sums of word times power, for two primes; the longest common extension of two places by bisection."""

    def __init__(self, words: np.ndarray, base: int):
        self.n, self.tables = len(words), []
        for k, p in enumerate(PRIMES):
            power = np.ones(len(words) + 1, "int64")
            done, step = 1, base + 7919 * k
            while done < len(power):  # step is base ** done
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * step % p
                step, done = step * step % p, done + more
            self.tables.append((p, power, np.r_[0, np.cumsum((words + 1) * power[:-1] % p)] % p))

    def same(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from i are the words from i + q, so many."""
        out = np.ones(len(i), bool)
        for p, power, total in self.tables:
            out &= (total[i + length] - total[i]) % p * power[q] % p == (total[i + q + length] - total[i + q]) % p
        return out

    def extension(self, i: np.ndarray, q: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i on (or before i) equal those q further on, at most limit."""
        low, high = np.zeros(len(i), "int64"), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.same(i - middle if back else i, q, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _candidates(words: np.ndarray, g: Grammar, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rule, period, anchor): two words from the anchor on, or before it, repeat a period further on.

    A run has half its length, at least two periods and three words, on one side of the boundary.
    """
    two = words[:-1] * (int(words.max(initial=0)) + 1) + words[1:]
    middle, whole = g.start + g.lsize, g.lsize + g.rsize
    for side, sign, first in ((g.rsize, 1, 0), (g.lsize, -1, -2)):
        most = np.where(side >= 3, np.minimum(side // 2, whole // exponent), 0)
        rules = np.flatnonzero(most)
        ends = np.cumsum(most[rules])
        cuts = np.searchsorted(ends, np.arange(0, ends[-1], AT_ONCE)) if len(ends) else []
        for a, b in zip(cuts, [*cuts[1:], len(rules)]):
            own = rules[a:b]
            r = np.repeat(own, most[own])
            q = np.arange(1, len(r) + 1) - np.repeat(np.cumsum(most[own]) - most[own], most[own])
            x = middle[r] + first
            hit = two[x] == two[x + sign * q]
            r, q = r[hit], q[hit]
            yield r, q, middle[r] if sign > 0 else middle[r] - q


def _crossing(words: np.ndarray, g: Grammar, minimum: int, exponent: int, base: int) -> np.ndarray:
    """Rows (rule, start, end, period) of the runs across the boundary of each rule, at its own place; sorted by rule."""
    hashes, found = None, []
    for r, q, x in _candidates(words, g, exponent):
        if not len(r):
            continue
        hashes = hashes or Hashes(words, base)
        start, middle = g.start[r], g.start[r] + g.lsize[r]
        end = middle + g.rsize[r]
        a = x - hashes.extension(x, q, x - start, back=True)
        b = x + q + hashes.extension(x, q, end - q - x)
        fit = (a < middle) & (b > middle) & (b - a >= np.maximum(minimum, exponent * q))
        found.append(np.stack([r, a, b, q], axis=1)[fit])
    rows = np.concatenate(found or [np.zeros((0, 4), "int64")])
    rows = rows[np.lexsort(rows.T[::-1])]
    # Multiples of the smallest period give the same interval.
    return rows[np.r_[True, (np.diff(rows[:, :3], axis=0) != 0).any(axis=1)]] if len(rows) else rows


def _everywhere(g: Grammar, rows: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) at all places of the rules' derivations."""
    n = len(g.left)
    number = np.bincount(rows[:, 0], minlength=n) if n else np.zeros(0, "int64")
    before, holds = np.cumsum(number) - number, np.r_[number > 0, False]
    for a, b in zip(g.rounds, g.rounds[1:]):
        below = [np.where(s[a:b] >= g.n_words, s[a:b] - g.n_words, n) for s in (g.left, g.right)]
        holds[a:b] |= holds[below[0]] | holds[below[1]]
    at, sym, out = *g.roots, []
    while True:
        rule = np.where(sym >= g.n_words, sym - g.n_words, n)
        at, rule = at[holds[rule]], rule[holds[rule]]
        if not len(rule):
            return np.concatenate(out or [np.zeros((0, 3), "int64")])
        m = number[rule]
        own = rows[np.repeat(before[rule] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        moved = np.repeat(at - g.start[rule], m)
        out.append(np.stack([own[:, 1] + moved, own[:, 2] + moved, own[:, 3]], axis=1))
        at, sym = np.concatenate([at, at + g.lsize[rule]]), np.concatenate([g.left[rule], g.right[rule]])


def _maximal(rows: np.ndarray, n: int) -> np.ndarray:
    """Intervals of one period that overlap by a period or more are parts of one run; runs by start, then period."""
    if not len(rows):
        return rows
    a, b, q = rows[np.lexsort((rows[:, 0], rows[:, 2]))].T
    kind = np.cumsum(np.r_[0, np.diff(q) != 0]) * (n + 1)
    reach = np.maximum.accumulate(kind + b) - kind
    head = np.flatnonzero(np.r_[True, (np.diff(q) != 0) | (a[1:] > reach[:-1] - q[1:])])
    out = np.stack([a[head], np.maximum.reduceat(b, head), q[head]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _true(words: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> bool:
    """Whether the intervals repeat word by word, and no further."""
    last = len(words) - 1
    for a, b, q in rows.tolist():
        more = (a and doc[a - 1] == doc[a] and words[a - 1] == words[a - 1 + q]) or (b <= last and doc[b] == doc[a] and words[b] == words[b - q])
        if more or not np.array_equal(words[a : b - q], words[a + q : b]):
            return False
    return True


def find_runs(words: np.ndarray, doc: np.ndarray, minimum: int = MINIMUM, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, end, period) of the runs of documents that follow each other, by start, then period."""
    g, base = Grammar(words, doc), 1000003
    while True:
        rows = _maximal(_everywhere(g, _crossing(words, g, minimum, exponent, base)), len(words))
        if _true(words, doc, rows):
            return rows
        base += 2  # hashes that agree by chance


def _described(ids: list, texts: list[list[bytes]], minimum: int, exponent: int) -> pa.RecordBatch:
    every = [w for own in texts for w in own]
    number = {w: i for i, w in enumerate(dict.fromkeys(every))}
    words = np.fromiter(map(number.__getitem__, every), "int64", len(every))
    sizes = np.array([len(own) for own in texts], "int64")
    ends = np.cumsum(sizes)
    rows = find_runs(words, np.repeat(np.arange(len(texts)), sizes), minimum, exponent)
    change = np.zeros(len(words) + 1, "int64")
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    owner = np.searchsorted(ends, rows[:, 0], side="right")
    first = ends - sizes
    collapsed = [b" ".join(own) for own in texts]
    for d in np.unique(owner).tolist():
        mask = kept[first[d] : ends[d]].tolist()
        collapsed[d] = b" ".join([w for w, k in zip(texts[d], mask) if k])
    cuts = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))] if len(texts) else np.zeros(1, "int64")
    fields = pa.StructArray.from_arrays([pa.array(rows[:, 0] - first[owner]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(cuts, "int32"), fields)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, "int64"), "n_words": pa.array(sizes), "runs": runs, "collapsed": pa.array(collapsed, "binary")})


def periodic_runs(docs: DataFrame, minimum: int = MINIMUM, exponent: int = EXPONENT) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period in words, by start, then period), collapsed.

    A run is a stretch of at least minimum words and exponent smallest periods that no neighbouring word extends; words
    are separated by ASCII white space. collapsed has the words that no run repeats: of each run the first period stays.
    Null, empty and blank texts have no words, no runs and an empty collapsed text. Ids may be null or repeat, other
    columns are ignored, an empty table gives an empty result. Texts of any length are taken whole, at some 300 bytes a word.
    """
    if minimum < 6 or exponent < 4:
        raise ValueError("runs of under 6 words or 4 periods aren't found")
    small_batches(docs.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = (text.as_py() or b"").split()
                if texts and held + len(own) > TOGETHER:
                    yield _described(ids, texts, minimum, exponent)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(own)
                held += len(own)
            if texts:
                yield _described(ids, texts, minimum, exponent)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(describe, RESULT).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document by the crc32 of its id, the words from some place on repeat with some period."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    n, g = F.size("words").cast("long"), F.col("g")
    a = g % F.greatest(n, F.lit(1))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    i32 = lambda x: x.cast("int")
    tail: Column = F.flatten(F.array_repeat(F.slice("words", i32(a + 1), i32(p)), i32(F.ceil((n - a) / p))))
    changed = F.slice(F.concat(F.slice("words", F.lit(1), i32(a)), tail), F.lit(1), i32(n))
    return rows.select("doc_id", F.when(n > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_tails(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("best", longest).withColumn("length", -F.col("best.shorter"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        "length",
        F.col("best.period").alias("period"),
        F.expr("1000 * length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
