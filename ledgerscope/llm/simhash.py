"""SimHash near-duplicates through an inverted index over positional bytes with count filtering.

A fingerprint has eight positional bytes. Two fingerprints within three bits differ in at most three of
them, so they share at least five: the count filter. Instead of listing every pair that shares one byte
and counting, which grows with the square of a posting, a posting here is kept per *five* positional bytes:
a pair reaches the count of five exactly when it meets in one of the 56 postings of five positions. The
members of a posting differ in 24 bits only, which bounds a posting by 2**24 distinct fingerprints
whatever the input; it is verified by Hamming distance and returns a spanning set of links, never pairs.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm import near_copies
from ledgerscope.llm.shared import as_bytes, fresh, map_batches, quoted, same
from ledgerscope.operators.components import component_labels
from ledgerscope.session import pin

MAX_BITS = 3
SHARED_BYTES = 8 - MAX_BITS
SEED = 42
_POSITIONS = list(combinations(range(8), SHARED_BYTES))


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes | None, words: int = 3, block: int = 1 << 18) -> bytes:
    """The fingerprint of a text as eight bytes, high byte first; zero for a text without words.

    Words are runs without ASCII white space, A-Z lower-cased. Shingles count as often as they occur;
    fewer words than a shingle has make one shingle.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    size = min(words, len(tokens))
    n = len(tokens) - size + 1
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, block):
        part = [digest(joined[a:b - 1], SEED) for a, b in zip(starts[at:min(at + block, n)], ends[at + size - 1:])]
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def _prints(batch: pa.RecordBatch) -> dict:
    prints = np.frombuffer(b"".join(fingerprint(t) for t in as_bytes(batch, "text")), ">i8")
    return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "print": prints.astype(np.int64)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, print)`` per row: the fingerprint as a signed long and a hash that names the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return map_batches(rows, _prints, "doc_id long, text_key long, print long")


def _flips() -> np.ndarray:
    ones = [1 << b for b in range(24)]
    return np.array([sum(c) for k in range(1, MAX_BITS + 1) for c in combinations(ones, k)], np.int64)


def _free_bits(members: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """The 24 bits in which the members of a posting can differ."""
    out = np.zeros(len(members), np.int64)
    for i, p in enumerate(p for p in range(8) if p not in positions):
        out |= ((members >> (8 * p)) & 0xFF) << (8 * i)
    return out


def spanning_links(members: np.ndarray, positions: tuple[int, ...], probe_from: int = 1200) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect what Hamming distance <= 3 connects within one posting.

    Small postings compare the frontier of a search with all that is left. From ``probe_from`` members on, the
    2,324 values within three bits are looked up instead, so the work is linear in the posting.
    """
    free = _free_bits(members, positions)
    children, roots = [], []
    if len(members) < probe_from:
        left = np.arange(len(members))
        while len(left) > 1:
            root, frontier, left = left[0], left[:1], left[1:]
            while len(frontier) and len(left):
                near = (np.bitwise_count(free[frontier][:, None] ^ free[left][None, :]) <= MAX_BITS).any(axis=0)
                frontier, left = left[near], left[~near]
                children.append(members[frontier])
                roots.append(np.full(len(frontier), members[root]))
    else:
        flips = _flips()
        at = np.full(1 << 24, -1, np.int32)
        at[free] = np.arange(len(members), dtype=np.int32)
        for root in range(len(members)):
            if at[free[root]] < 0:
                continue
            at[free[root]] = -1
            frontier = np.array([root])
            while len(frontier):
                found = []
                for i in range(0, len(frontier), 512):
                    probes = (free[frontier[i:i + 512]][:, None] ^ flips[None, :]).ravel()
                    hit = np.unique(probes[at[probes] >= 0])
                    found.append(at[hit].astype(np.int64))
                    at[hit] = -1
                frontier = np.concatenate(found)
                children.append(members[frontier])
                roots.append(np.full(len(frontier), members[root]))
    none = np.zeros(0, np.int64)
    return np.concatenate([*children, none]), np.concatenate([*roots, none])


def _links(batches):
    """Walk the sorted postings of a partition; a posting may span batches."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held = None

    def verified(slot, prints, cuts):
        children, roots = [], []
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        near = np.bitwise_count((prints[two] ^ prints[two + 1]).view(np.uint64)) <= MAX_BITS
        children.append(prints[two + 1][near])
        roots.append(prints[two][near])
        for i in np.flatnonzero(sizes > 2):
            a, b = spanning_links(prints[cuts[i]:cuts[i + 1]], _POSITIONS[slot[cuts[i]]])
            children.append(a)
            roots.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(children)), pa.array(np.concatenate(roots))], schema=schema)

    for batch in batches:
        part = [batch.column(c).to_numpy() for c in ("slot", "posting", "print")]
        if held is not None:
            part = [np.concatenate([a, b]) for a, b in zip(held, part)]
        slot, posting, prints = part
        if not len(prints):
            continue
        cuts = np.flatnonzero((np.diff(slot) != 0) | (np.diff(posting) != 0)) + 1
        cuts = np.concatenate([[0], cuts])
        if len(cuts) > 1:
            yield verified(slot, prints, cuts)
        held = [a[cuts[-1]:] for a in part]
    if held is not None and len(held[2]) > 1:
        yield verified(held[0], held[2], np.array([0, len(held[2])]))


def links(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect all fingerprints within three bits of each other; ``prints(print)`` is distinct."""
    masks = F.array(*[F.lit(_mask(p)).cast("long") for p in _POSITIONS])
    postings = prints.select("print", F.posexplode(masks).alias("slot", "mask")).select(
        "slot", F.col("print").bitwiseAND(F.col("mask")).alias("posting"), "print")
    dealt = postings.repartition("slot", "posting").sortWithinPartitions("slot", "posting", "print")
    return dealt.mapInArrow(_links, "u long, v long")


def components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, text_key, fingerprint, component_id``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own included; null only where the whole
    component has null ids. Null and empty texts have fingerprint zero and link like any other. Repeated rows
    each get a row. An empty table gives an empty result.
    """
    rows = pin(fingerprints(docs), "simhash")
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    labels = component_labels(pin(links(prints.select("print")), "links"))
    named = pin(prints.join(labels, prints["print"] == labels["node"], "left").select(
        "print", "first_id", F.coalesce("component", "print").alias("component")), "classes")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(least, "component").select("print", "component", "component_id")
    return rows.join(classes, "print").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component", "component_id")


def linked_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of the set keys in ``sets(text_key, set_key)`` that connect what SimHash links: equal fingerprints and those within three bits."""
    prints = fingerprints(docs).select("text_key", "print").distinct()
    keyed = pin(prints.join(sets.select("text_key", "set_key").distinct(), "text_key").select("print", "set_key").distinct(), "simhash")
    first = keyed.groupBy("print").agg(F.min("set_key").alias("first"))
    equal = keyed.join(first, "print").select(F.col("first").alias("u"), F.col("set_key").alias("v"))
    end = lambda name: first.select(F.col("print").alias(name), F.col("first").alias(f"{name}_set"))
    near = links(keyed.select("print").distinct()).distinct().join(end("u"), "u").join(end("v"), "v").select(
        F.col("u_set").alias("u"), F.col("v_set").alias("v"))
    return equal.unionAll(near).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one row of each component: the smallest doc_id (nulls last), then the smallest text hash; all columns stay.

    Components are those of ``near_copies``: five-word shingles, Jaccard similarity 0.8. SimHash links are its first candidates, each of
    which the exact comparison judges; most pairs at that similarity differ in more than three bits, and its prefix filter finds those.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    first = near_copies.components(docs, linked_sets).groupBy("component").agg(F.min(order).alias("first"))
    key, id_, hash_ = fresh(docs, "text_hash"), fresh(docs, "kept_id"), fresh(docs, "kept_hash")
    kept = first.select(F.col("first.id").alias(id_), F.col("first.key").alias(hash_))
    tagged = docs.withColumn(key, F.xxhash64("text"))
    joined = tagged.join(kept, same(docs, ["doc_id", key], [id_, hash_]))
    return joined.dropDuplicates(["doc_id", key]).select(*[quoted(c) for c in docs.columns])
