import random

import xxhash

import corpus_pipeline as cp
from geofuse.llm import near_copies, simhash, word_hashes


def plain_kept(rows):
    """rows of (doc_id, text), ids distinct -> the least id of each group, by comparing all with all."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        w = text.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_near_copies_equal_all_pairs(spark, sf):
    """The given texts, groups around the threshold, a chain, and a line that many share."""
    rng = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    line = "one common line that stands in a great many of these texts here"
    for size in (4, 5, 6, 30, 100):
        for _ in range(4):
            t = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for _ in range(10):
                u = list(t)
                for _ in range(rng.randrange(4)):
                    u[rng.randrange(size)] = f"v{rng.randrange(5000)}"
                texts += [" ".join(u), f"{line} {' '.join(u)}"]
                t = u if rng.random() < 0.3 else t
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    out = cp.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sf)
    want = plain_kept(rows)
    assert sorted(r["doc_id"] for r in out.collect()) == want and 200 < len(want) < len(rows) - 100


def test_no_order_of_shingles_loses_links(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(60)], []
    for d in range(60):
        u = list(base)
        for _ in range(d % 4):
            u[rng.randrange(60)] = f"v{d}"
        rows.append((d, " ".join(u)))
    out = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == plain_kept(rows)


def test_fingerprints_propose_and_are_verified(spark, monkeypatch):
    """The stage's pairs are first those that fingerprints link; what isn't alike by its shingles stays."""
    phrase = "one two three four five six seven " * 60
    base = [f"w{i}" for i in range(300)]
    texts = [phrase + "alpha beta gamma", phrase + "delta eps zeta eta theta", " ".join(base), " ".join([*base[:-1], "x"]), "something else entirely is written here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fp = [simhash.fingerprint(t) for t in texts]
    assert (fp[0] ^ fp[1]).bit_count() <= 2
    seen, plain = [], near_copies._verified

    def verified(pairs, texts):
        out = plain(pairs, texts)
        seen.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(near_copies, "_verified", verified)
    assert {r["doc_id"] for r in cp.drop_near_copies(spark, docs, "").collect()} == {0, 1, 2, 4}
    assert seen[0] == (1, 0) and sum(n for _, n in seen) >= 1


def test_long_texts_around_the_threshold(spark):
    """Sizes that differ, up to the bounds of what can be near: none of the bounds on what two prefixes share loses a link."""
    rng = random.Random(6)
    texts = []
    for size in (40, 300, 1300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for gone in range(14):
            u = list(base[: size - rng.randrange(1 + size // 5)]) if gone % 2 else list(base)
            for _ in range(rng.randrange(1 + size // 36)):
                u[rng.randrange(len(u))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(u + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1 + size // 25))]))
    rows = list(enumerate(texts))
    out = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    want = plain_kept(rows)
    assert sorted(r["doc_id"] for r in out.collect()) == want and 6 < len(want) < len(rows) - 6


def test_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """Long texts meet in a passage of theirs, too few words of it to be near copies: none is verified."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(d, " ".join([f"w{rng.randrange(10**6)}" for _ in range(1500)] + passage)) for d in range(12)]
    compared, plain = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, texts: compared.append(pairs.count()) or plain(pairs, texts))
    out = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == 12 and sum(compared) == 0


def test_rounds_end_where_they_spare_nothing(spark, monkeypatch):
    """Long texts with much in common, none near another: a round for the nearest of each, then all the others at once."""
    rng = random.Random(8)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(3000)], []
    for d in range(14):
        own = [f"v{d}-{i}" for i in range(300)]
        rows.append((d, " ".join([*base[: 200 * d], *own, *base[200 * d + 300 :]])))
    compared, plain = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, texts: compared.append(pairs.count()) or plain(pairs, texts))
    out = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == 14 and len(compared) <= 3 and sum(compared) >= 91


def test_hashes_of_stretches_equal_the_library():
    rng = random.Random(7)
    odd = ["", None, "a", "a b", " A\tb \x0bC  d\n", "x" * 20000, "\u00e9 \u00e8 " * 50, "\ud800 z y", "  ", "\x1c A\x85b c", "0123456789 " * 9]
    texts = odd + [" ".join("".join(rng.choices("abcXYZ", k=rng.randrange(1, 14))) for _ in range(rng.randrange(1, 400))) for _ in range(50)]
    texts.insert(9, " ".join(f"w{i}" for i in range(200_000)))  # longer than a run
    for words in (1, 3):
        for text, (plain, h) in zip(texts, word_hashes.hashed(texts, words), strict=True):
            w = (text or "").encode("utf-8", "surrogatepass").lower().split()
            assert plain == b" ".join(w)
            assert h.tolist() == [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(len(w) - words + 1, min(len(w), 1)))]


def test_pairs_are_told_apart_by_all_bits_of_their_keys(spark):
    """Keys that are equal as doubles follow each other."""
    k = 1 << 60
    rows = [(k, "a b c d e", "a b c d e"), (k + 1, "a b c d e", "f g h i j"), (k + 2, "f g h i j", "f g h i j")]
    pairs = spark.createDataFrame(rows, "b long, x string, y string").coalesce(1)
    assert [r[0] for r in pairs.select(near_copies._near("b", "x", "y")).collect()] == [True, False, True]
