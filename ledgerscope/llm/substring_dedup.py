"""Removal of repeated byte strings by distributed prefix doubling on a sampled suffix array.

A byte goes when a string of ``LENGTH`` (50) bytes over it also starts in a document with a smaller id. Positions get ranks
by the bytes that follow them; a rank is a 64-bit name of the bytes, as the order of unequal strings is never asked
for. Spark brings equal ranks together, and a position whose rank no other document shares drops out. The
rounds, in which the ranked length doubles from 25 to 50:

1. Ranks of 25 bytes. Of every 26 neighbouring positions only the one with the smallest rank, the anchor, is sorted: a repeated
   string has the same anchor wherever it occurs, so positions without a shared anchor are out.
2. Ranks of 50 bytes, to the right and to the left of every shared anchor. Where both have an earlier document, all
   strings over the anchor are covered. That settles the inside of repeats.
3. What is left are the ends of repeats. Their anchors are asked for, and wherever such an anchor occurs,
4. all 50-byte strings over it are ranked.

Texts are packed into batches, stored once in a table bucketed by batch: the rounds join to it without moving a text.
Ranks travel as packed pages, one per batch and bucket of ranks, each rank once per batch with its smallest document, so
a string in a third of all documents is thinned before it is shuffled. Answers come back as bits in page order.
The number of buckets grows with the input.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import arrow_schema, as_bytes
from ledgerscope.session import pin, shared_folder

LENGTH, GRAM = 50, 25
BATCH_BYTES = 3 << 20
BUCKET_BYTES = 16 << 20
_NO_ID = np.iinfo(np.int64).max
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier modulo 2**64 and their inverses."""
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
        for name, base in (("up", _MUL), ("down", inverse)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Batch:
    """Texts of one batch end to end, in the order of their ids, with hashes of any stretch."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes) -> None:
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.text = np.frombuffer(texts, np.uint8)
        self.ends = np.cumsum(self.sizes)
        n = len(self.text)
        up, self.down = _powers(n + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[self.text] * up[:n])])
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        inside = np.ones(max(0, n - LENGTH + 1), bool)  # no string may cross the end of its document
        for end, size in zip(self.ends.tolist(), self.sizes.tolist()):
            inside[max(end - size, end - LENGTH + 1):end] = False
        self.inside, self.starts = inside, np.flatnonzero(inside)
        self.anchors = self._anchors(n) if len(self.starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[at + size] - self.sums[at]) * self.down[at])

    def _anchors(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per valid string: the rank of its anchor and where that is; equal strings have anchors of equal rank."""
        low = _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[:n - GRAM + 1])
        low &= ~np.uint64(63)
        low |= (np.arange(n - GRAM + 1) & 63).astype(np.uint64)
        width = LENGTH - GRAM + 1
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:size - width], low[width - size:])[self.inside]
        place = low.astype(np.int64)  # the lowest six bits are those of the place
        place -= self.starts
        place &= 63
        place += self.starts
        low >>= np.uint64(6)
        return low, place

    def id_of(self, at: np.ndarray) -> np.ndarray:
        return self.ids[self.doc[at]]


class Question:
    """Distinct ranks of a batch with their smallest id and a mark, dealt to buckets; and what the answers say."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, marks: np.ndarray | None, buckets: int) -> None:
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        cut = np.flatnonzero(first)
        self.keys = keys[cut]
        #: the distinct key of every entry, so that nothing is searched for later
        self.group = np.empty(len(keys), np.int64)
        self.group[order] = np.cumsum(first) - 1
        if not len(cut):
            self.least, self.marks = np.zeros(0, np.int64), np.zeros(0, bool)
        else:
            self.least = np.minimum.reduceat(ids, cut)
            # without marks: more than one document here
            self.marks = np.maximum.reduceat(ids, cut) != self.least if marks is None else np.logical_or.reduceat(marks[order], cut)
        bucket = _mix(self.keys * np.uint64(0x94D049BB133111EB)) % np.uint64(buckets)
        bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short numbers are sorted in linear time
        self.order = np.argsort(bucket, kind="stable")
        bucket = bucket[self.order]
        begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        self.names = bucket[begins]
        self.begins = np.append(begins, len(bucket))

    def pages(self) -> list[tuple[int, bytes, bytes, bytes]]:
        """Per bucket: keys, ids in byte planes (they compress better), marks."""
        out = []
        for name, a, b in zip(self.names.tolist(), self.begins, self.begins[1:]):
            i = self.order[a:b]
            planes = np.ascontiguousarray(self.least[i].view(np.uint8).reshape(-1, 8).T)
            out.append((name, self.keys[i].tobytes(), planes.tobytes(), np.packbits(self.marks[i]).tobytes()))
        return out

    def answered(self, answers: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Per distinct key: whether a smaller document elsewhere has it, and whether any mark or other document is on it."""
        smaller, other = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for name, a, b in zip(self.names.tolist(), self.begins, self.begins[1:]):
            i = self.order[a:b]
            for target, bits in zip((smaller, other), answers[name]):
                target[i] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return smaller, other

    def looked_up(self, values: np.ndarray) -> np.ndarray:
        """Per entry: the value of its key."""
        return values[self.group]

    def earlier(self, ids: np.ndarray, smaller: np.ndarray) -> np.ndarray:
        """Per entry: whether a smaller document has its key, here or elsewhere."""
        return smaller[self.group] | (self.least[self.group] < ids)


def _distinct(at: np.ndarray, n: int) -> np.ndarray:
    """The distinct places below ``n``, ascending."""
    seen = np.zeros(n, bool)
    seen[at] = True
    return np.flatnonzero(seen)


class Rounds:
    """What a batch asks in each round, given the answers to the rounds before."""

    def __init__(self, batch: Batch, buckets: int, answers: list) -> None:
        self.batch, self.buckets = batch, buckets
        self.answers: list[dict] = [{}, {}, {}, {}]
        for round_, bucket, smaller, other in answers or []:
            self.answers[round_][bucket] = (smaller, other)

    def ask(self, round_: int) -> Question:
        return (lambda: self.grams, lambda: self.sides, lambda: self.wanted, lambda: self.strings)[round_]()

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of neighbouring strings with one anchor rank and document begin, and the run of each string."""
        keys, docs = self.batch.anchors[0], self.batch.doc[self.batch.starts]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]) if len(keys) else np.zeros(0, bool)
        return np.flatnonzero(first), np.cumsum(first) - 1

    @cached_property
    def run_keys(self) -> np.ndarray:
        return self.batch.anchors[0][self.runs[0]]

    @cached_property
    def run_ids(self) -> np.ndarray:
        return self.batch.id_of(self.batch.starts[self.runs[0]])

    @cached_property
    def grams(self) -> Question:
        return Question(self.run_keys, self.run_ids, None, self.buckets)

    @cached_property
    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """Per run: whether an earlier, and whether any other document has its anchor."""
        smaller, other = self.grams.answered(self.answers[0])
        return self.grams.earlier(self.run_ids, smaller), self.grams.looked_up(other)

    @cached_property
    def side_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the 50-byte strings right and left of shared anchors, within their documents."""
        places = _distinct(self.batch.anchors[1][self.shared[1][self.runs[1]]], len(self.batch.text))
        ends = self.batch.ends[self.batch.doc[places]]
        begins = ends - self.batch.sizes[self.batch.doc[places]]
        right, left = places[places + LENGTH <= ends], places[places - (LENGTH - GRAM) >= begins] - (LENGTH - GRAM)
        at = _distinct(np.concatenate([right, left]), len(self.batch.text))
        return at, self.batch.hashes(at, LENGTH), self.batch.id_of(at)

    @cached_property
    def sides(self) -> Question:
        return Question(*self.side_entries[1:], None, self.buckets)

    def _covered(self, at: np.ndarray) -> np.ndarray:
        """Bytes that lie in a string that starts at one of ``at``."""
        n = len(self.batch.text) + 1
        steps = np.bincount(at, minlength=n) - np.bincount(at + LENGTH, minlength=n)
        return np.cumsum(steps[:-1], dtype=np.int32) > 0

    @cached_property
    def settled(self) -> np.ndarray:
        at, _, ids = self.side_entries
        return at[self.sides.earlier(ids, self.sides.answered(self.answers[1])[0])]

    @cached_property
    def wanted(self) -> Question:
        earlier, other = self.shared
        begins, run = self.runs
        sums = np.zeros(len(self.batch.text) + 1, np.int64)
        np.cumsum(self._covered(self.settled), out=sums[1:])
        bare = (sums[LENGTH:] - sums[:-LENGTH] < LENGTH)[self.batch.inside]
        open_ = earlier & np.logical_or.reduceat(bare, begins) if len(begins) else earlier
        return Question(self.run_keys[other], np.zeros(int(other.sum()), np.int64), open_[other], self.buckets)

    @cached_property
    def string_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked, other = self.wanted.answered(self.answers[2])[1], self.shared[1]
        some = other.copy()
        some[other] = self.wanted.looked_up(asked)
        at = self.batch.starts[some[self.runs[1]]]
        return at, self.batch.hashes(at, LENGTH), self.batch.id_of(at)

    @cached_property
    def strings(self) -> Question:
        return Question(*self.string_entries[1:], None, self.buckets)

    def gone(self) -> np.ndarray:
        """All bytes to remove."""
        at, _, ids = self.string_entries
        return self._covered(np.concatenate([self.settled, at[self.strings.earlier(ids, self.strings.answered(self.answers[3])[0])]]))


def _packed(batches):
    """Documents into batches of about ``BATCH_BYTES``; a longer text is a batch of its own."""
    schema = arrow_schema(_BATCH)
    part, number = TaskContext.get().partitionId(), 0
    ids, keys, texts, size = [], [], [], 0

    def row():
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        held = [texts[i] for i in order]
        return pa.RecordBatch.from_pydict({
            "batch": [part << 32 | number], "n_bytes": [size],
            "ids": [np.array([_NO_ID if ids[i] is None else ids[i] for i in order], np.int64).tobytes()],
            "sizes": [np.array([len(t) for t in held], np.int64).tobytes()], "texts": [b"".join(held)]}, schema=schema)

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text")):
            text = text or b""
            if ids and size + len(text) > BATCH_BYTES:
                yield row()
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text)
    if ids:
        yield row()


_BATCH = "batch long, n_bytes long, ids binary, sizes binary, texts binary"
_PAGE = "batch long, bucket long, keys binary, ids binary, marks binary"
_ANSWER = "batch long, bucket long, smaller binary, other binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _answers(pages: pa.Table) -> pa.Table:
    """Bring equal ranks of a bucket together; per page entry a bit for a smaller document, and one for any mark or other document."""
    keys = [np.frombuffer(k, np.uint64) for k in pages.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    ids = np.concatenate([np.frombuffer(i, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel() for i in pages.column("ids").to_pylist()])
    marks = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(pages.column("marks").to_pylist(), sizes)])
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    sorted_keys, sorted_ids = keys[order], ids[order]
    cut = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    least, most = np.minimum.reduceat(sorted_ids, cut), np.maximum.reduceat(sorted_ids, cut)
    marked = np.maximum.reduceat(marks[order], cut) > 0
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(keys))))
    smaller, other = least[group] < ids, (marked | (least != most))[group]
    ends = np.cumsum(sizes)
    return pa.table({"batch": pages.column("batch"), "bucket": pages.column("bucket"),
                     "smaller": [np.packbits(smaller[e - n:e]).tobytes() for e, n in zip(ends, sizes)],
                     "other": [np.packbits(other[e - n:e]).tobytes() for e, n in zip(ends, sizes)]}, schema=arrow_schema(_ANSWER))


def _rounds_of(batch: pa.RecordBatch, buckets: int):
    columns = [batch.column(c).to_pylist() for c in ("batch", "ids", "sizes", "texts", "answers")]
    for name, ids, sizes, texts, answers in zip(*columns):
        told = [(a["round"], a["bucket"], a["smaller"], a["other"]) for a in answers or []]
        yield name, Rounds(Batch(ids, sizes, texts), buckets, told)


def removals(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    ``spans`` are starts and ends of the maximal removed runs in bytes. Strings are judged on the input and never cross
    documents; null counts as empty. Rows with equal ids, and rows with null ids among themselves, don't remove each
    other's bytes; null ids come after all others. Repeated rows each get a row; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(_packed, _BATCH)
    name = f"batches_{uuid.uuid4().hex}"
    parts = max(1, rows.rdd.getNumPartitions())
    (packed.write.bucketBy(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "batch").option("compression", "zstd")
     .option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name))
    batches = spark.table(name)
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    answers = None

    def told() -> DataFrame:
        if answers is None:
            return batches.withColumn("answers", F.lit(None).cast("array<struct<round:int,bucket:bigint,smaller:binary,other:binary>>"))
        grouped = answers.groupBy("batch").agg(F.collect_list(F.struct("round", "bucket", "smaller", "other")).alias("answers"))
        return batches.hint("merge").join(grouped, "batch", "left")

    for round_ in range(4):
        def ask(found, round_=round_):
            schema = arrow_schema(_PAGE)
            for batch in found:
                for key, rounds in _rounds_of(batch, buckets):
                    pages = rounds.ask(round_).pages()
                    yield pa.RecordBatch.from_pydict({"batch": [key] * len(pages), "bucket": [p[0] for p in pages], "keys": [p[1] for p in pages],
                                                      "ids": [p[2] for p in pages], "marks": [p[3] for p in pages]}, schema=schema)

        pages = told().mapInArrow(ask, _PAGE)
        new = pin(pages.groupBy("bucket").applyInArrow(_answers, _ANSWER).withColumn("round", F.lit(round_)), "answers")
        answers = new if answers is None else answers.unionByName(new)

    def cut(found):
        schema = arrow_schema(_RESULT)
        for batch in found:
            for _, rounds in _rounds_of(batch, buckets):
                b, gone, out, at = rounds.batch, rounds.gone(), [], 0
                for doc, size in zip(b.ids.tolist(), b.sizes.tolist()):
                    mine = gone[at:at + size]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                    kept = b.text[at:at + size][~mine].tobytes()
                    out.append({"doc_id": None if doc == _NO_ID else doc, "n_bytes": size, "n_removed": int(mine.sum()), "n_spans": len(edges) // 2,
                                "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": edges.tolist()})
                    at += size
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return told().mapInArrow(cut, _RESULT)
