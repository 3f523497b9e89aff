"""All pairs of texts whose sets of five-word shingles have a Jaccard similarity of four fifths or more.

The search is exact. Shingles are put in one fixed order, those that a sample of the texts holds often last. Two sets that
are similar enough share a shingle among the first ``n - ceil(0.8 n) + 1`` of each: the prefix filter. A posting is kept
per such shingle. A SimHash radius can't take its place: pairs at 0.8 differ in up to eleven bits and more, at which no byte
of two fingerprints has to be equal. What SimHash does link is compared first, then candidates in three rounds. The first compares the
members of a posting with one of them, the second neighbours and first members of MinHash buckets, in which mostly similar sets meet; they
find large groups of copies without their pairs. The last, which makes the search exact,
compares those members of postings that aren't united yet, where sizes and places in the order allow the similarity.

Most candidates share a passage and no more, so sketches are compared before whole sets: a bit per residue of the hashes tells
whether the set holds an odd number of them. Sets differ in at least as many shingles as their sketches do in bits, so a pair that differs
in too many bits can't be similar, and only the rest has its texts brought together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import arrow_schema, as_bytes, map_batches
from ledgerscope.operators.components import component_labels
from ledgerscope.session import pin, release

WORDS = 5
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
ORDERED = 100_000
SAMPLED = 10
#: Buckets per set and smallest hashes in a bucket's name: two sets at 0.8 share a bucket with a chance of 97 in 100.
BUCKETS, SMALLEST = 12, 6
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BUCKETS * SMALLEST, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle has make one shingle, no words none."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    size = min(WORDS, len(tokens))
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i:n + i]
    return np.unique(out)


def prefix_length(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1 if n else 0


def sketch(found: np.ndarray) -> bytes:
    """Parity of the set per residue of its hashes, a power of two of them and at least one bit a shingle."""
    size = max(64, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_similar(a: bytes, n: int, b: bytes, m: int) -> bool:
    """False only if sets of ``n`` and ``m`` shingles with these sketches can't be similar."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) > len(y):  # the residues of half the modulus
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    most = n + m - 2 * -(-OVER * (n + m) // (OVER + UNDER))
    return int(np.bitwise_count(x ^ y).sum()) <= most


def buckets(found: np.ndarray, block: int = 1 << 14) -> list[int]:
    """Names of the MinHash buckets of a set; an empty one is in none."""
    if not len(found):
        return []
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(found), block):
        mixed = found[at:at + block, None] * _FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
    name = np.arange(BUCKETS, dtype=np.uint64)
    for part in least.reshape(BUCKETS, SMALLEST).T:
        name = (name ^ part) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view(np.int64).tolist()


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


_CLASS = "doc_id long, text_key long, set_key long, n int, sketch binary, buckets array<long>"


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, set_key, n, sketch, buckets)`` per row; ``set_key`` names the set of shingles."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))

    def named(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(t) for t in as_bytes(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "set_key": [_key(s) for s in found],
                "n": [len(s) for s in found], "sketch": [sketch(s) for s in found], "buckets": [buckets(s) for s in found]}

    return map_batches(rows, named, _CLASS)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that sampled texts share, sorted, and how many hold each. They only set the order: any is right."""
    def held(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(t) for t in as_bytes(batch, "text")]
        return {"shingle": np.concatenate(found).view(np.int64)}

    texts = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counted = map_batches(texts, held, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = counted.orderBy(F.desc("n"), "shingle").limit(ORDERED).collect()
    shingles = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array([r["n"] for r in rows], np.int64)[order]


_POSTINGS = "shingle long, set_key long, n int, place int"


def _postings(docs: DataFrame) -> DataFrame:
    often, times = _frequent(docs)

    def prefixes(batch: pa.RecordBatch) -> dict:
        parts = [[np.zeros(0, kind)] for kind in (np.uint64, np.int64, np.int32, np.int32)]
        for text in as_bytes(batch, "text"):
            found = shingle_set(text)
            if not len(found):
                continue
            if len(often):
                at = np.minimum(np.searchsorted(often, found), len(often) - 1)
                ordered = found[np.lexsort((found, np.where(often[at] == found, times[at], 0)))]
            else:
                ordered = found
            size = prefix_length(len(found))
            for part, value in zip(parts, (ordered[:size], np.full(size, _key(found)), np.full(size, len(found), np.int32), np.arange(size, dtype=np.int32))):
                part.append(value)
        shingle, key, n, place = map(np.concatenate, parts)
        return {"shingle": shingle.view(np.int64), "set_key": key, "n": n, "place": place}

    return map_batches(docs.select("text"), prefixes, _POSTINGS)


def _by_posting(df: DataFrame, ddl: str, walk) -> DataFrame:
    """Apply ``walk`` to the postings of every partition, each given as arrays ordered by size and set."""
    names, schema = df.columns, arrow_schema(ddl)

    def run(batches):
        held = []  # pieces of the last posting, put together once it ends
        for batch in batches:
            part = [batch.column(c).to_numpy() for c in names]
            if not len(part[0]):
                continue
            cuts = np.flatnonzero(np.diff(part[0])) + 1
            if held and held[-1][0][-1] != part[0][0]:
                yield from pages(joined(held), np.array([0, sum(len(h[0]) for h in held)]))
                held = []
            if len(cuts) and held:
                first = joined([*held, [a[:cuts[0]] for a in part]])
                yield from pages(first, np.array([0, len(first[0])]))
                part, cuts, held = [a[cuts[0]:] for a in part], cuts[1:] - cuts[0], []
            if len(cuts):
                yield from pages(part, np.concatenate([[0], cuts]))
                part = [a[cuts[-1]:] for a in part]
            held.append(part)
        if held:
            yield from pages(joined(held), np.array([0, sum(len(h[0]) for h in held)]))

    def joined(parts):
        return [np.concatenate(c) for c in zip(*parts)]

    def pages(part, cuts):
        out, rows = [], 0
        for i in np.flatnonzero(np.diff(cuts) > 1):
            for found in walk(*[a[cuts[i]:cuts[i + 1]] for a in part]):
                if len(found[0]):
                    out.append(found)
                    rows += len(found[0])
                if rows > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)
                    out, rows = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return df.repartition("shingle").sortWithinPartitions("shingle", "n", "set_key").mapInArrow(run, ddl)


def _shared(shingle, key, n, place):
    """The distinct sets of a posting that has more than one."""
    new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(n) != 0)])
    if new.sum() > 1:
        yield shingle[new], key[new], n[new], place[new]


def _ends(n: np.ndarray) -> np.ndarray:
    """Per member the end of those that aren't too large for it."""
    return np.searchsorted(n, UNDER * n.astype(np.int64) // OVER, side="right")


def _stars(shingle, key, n, place):
    ends, i = _ends(n), 0
    while i < len(n):
        end = int(ends[i])
        yield np.full(end - i - 1, key[i]), key[i + 1:end]
        i = end


def _close(shingle, key, n, place):
    """The members of a bucket with its first one and with their neighbours, where sizes allow."""
    for _, keys, sizes, _ in _shared(shingle, key, n, place):
        yield from _stars(None, keys, sizes, None)
        near = np.flatnonzero(_ends(sizes)[:-1] > np.arange(1, len(keys)))
        yield keys[near], keys[near + 1]


def _others(shingle, key, n, place, component):
    if (component == component[0]).all():
        return
    ends, left = _ends(n), n - place
    for i in range(len(n) - 1):
        to = slice(i + 1, int(ends[i]))
        possible = (OVER + UNDER) * np.minimum(left[i], left[to]).astype(np.int64) >= OVER * (int(n[i]) + n[to].astype(np.int64))
        other = key[to][possible & (component[to] != component[i])]
        yield np.full(len(other), key[i]), other


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def _possible(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of set keys whose sketches allow the similarity."""
    sets = named.groupBy("set_key").agg(F.first(F.struct("n", "sketch")).alias("s"))
    side = lambda key, n, bits: sets.select(F.col("set_key").alias(key), F.col("s.n").alias(n), F.col("s.sketch").alias(bits))
    both = pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v").select("u", "v", "a", "n", "b", "m")

    def judged(batch: pa.RecordBatch) -> dict:
        near = pa.array([may_be_similar(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("a", "n", "b", "m")))], pa.bool_())
        return {c: batch.column(c).filter(near) for c in ("u", "v")}

    return map_batches(both, judged, "u long, v long")


def _verified(docs: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of set keys whose whole sets are similar."""
    possible = pin(_possible(named, pairs), "possible")
    wanted = possible.select(F.explode(F.array("u", "v")).alias("set_key")).distinct()
    texts = named.join(wanted, "set_key", "left_semi").groupBy("set_key").agg(F.min("text_key").alias("text_key"))
    held = docs.select("text", F.xxhash64("text").alias("text_key")).join(texts, "text_key").dropDuplicates(["set_key"])
    held = pin(held.select("set_key", "text"), "held")
    both = possible.join(held.select(F.col("set_key").alias("u"), F.col("text").alias("a")), "u").join(
        held.select(F.col("set_key").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def checked(batch: pa.RecordBatch) -> dict:
        near = pa.array([similar(shingle_set(a), shingle_set(b)) for a, b in zip(as_bytes(batch, "a"), as_bytes(batch, "b"))], pa.bool_())
        return {c: batch.column(c).filter(near) for c in ("u", "v")}

    found = pin(map_batches(both, checked, "u long, v long"), "similar")
    release(possible)
    release(held)
    return found


def _marked(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with the component that each set has by the links found so far."""
    labels = component_labels(links)
    return postings.join(labels, postings["set_key"] == labels["node"], "left").select(
        *postings.columns, F.coalesce("component", "set_key").alias("component"))


def components(docs: DataFrame, linked: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, text_key, component``, connected over all similar pairs.

    ``linked`` gives candidates ``(u, v)`` of another search over ``docs`` and the classes; they are compared before all others. Texts with the same set of shingles are alike; so are all texts without words. An empty table gives an empty result.
    """
    named = pin(classes(docs), "classes")
    postings = pin(_by_posting(_postings(docs), _POSTINGS, _shared), "postings")
    stars = pin(_by_posting(postings, "u long, v long", _stars).distinct(), "stars")
    met = named.select(F.explode("buckets").alias("shingle"), "set_key", "n", F.lit(0).alias("place"))
    stars = stars.unionAll(pin(_by_posting(met, "u long, v long", _close).distinct().join(stars, ["u", "v"], "left_anti"), "close"))
    if linked:
        given = pin(linked(docs, named), "linked")
        other = stars.join(given, (F.least(stars["u"], stars["v"]) == given["u"]) & (F.greatest(stars["u"], stars["v"]) == given["v"]), "left_anti")
        stars = given.unionAll(other)
    first = _verified(docs, named, stars)
    others = pin(_by_posting(_marked(postings, first), "u long, v long", _others).distinct().join(stars, ["u", "v"], "left_anti"), "others")
    release(postings)
    links = first.unionAll(_verified(docs, named, others))
    release(others)
    found = component_labels(links)
    return named.select("doc_id", "text_key", "set_key").join(found, named["set_key"] == found["node"], "left").select(
        "doc_id", "text_key", F.coalesce("component", "set_key").alias("component"))
