"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words. Patterns are the windows of 13 consecutive words of the benchmark items, or a whole
shorter item. Patterns of equal length share tables: SHIFT tells, for the last two words of the text window, how
far the window can move without missing a pattern; at shift zero the bucket of that suffix block gives the
patterns that end in it, and a direct comparison confirms them. Most positions are never looked at.

The benchmark is the stated query set. It is dealt into blocks of a bounded number of characters; each block's
tables go to the tasks, and all documents are scanned against every block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import as_bytes, fresh, map_batches, quoted, same
from ledgerscope.session import pin

WINDOW = 13
BLOCK_CHARS = 4_000_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (text or b"").translate(_LETTERS).split()


class Patterns:
    """Shift and bucket tables for each pattern length of one block of the benchmark."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW) -> None:
        windows: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                windows[size][tuple(words[i:i + size])].add(item)
        self.tables = []
        for size, patterns in sorted(windows.items()):
            width = min(2, size)
            shift: dict = {}
            bucket: dict = defaultdict(dict)
            for words, owners in patterns.items():
                for end in range(width, size + 1):
                    block = words[end - width:end]
                    block = block if width == 2 else block[0]
                    shift[block] = min(shift.get(block, size), size - end)
                bucket[block][words] = tuple(sorted(owners))
            self.tables.append((size, width, size - width + 1, shift, dict(bucket)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, end) of all occurrences, merged, and the items that own them."""
        found, items = [], set()
        n = len(words)
        for size, width, most, shift, bucket in self.tables:
            get, at = shift.get, size - 1
            while at < n:
                block = (words[at - 1], words[at]) if width == 2 else words[at]
                step = get(block, most)
                if step:
                    at += step
                    continue
                owners = bucket[block].get(tuple(words[at - size + 1:at + 1]))
                if owners:
                    items.update(owners)
                    found.append((at - size + 1, at + 1))
                at += 1
        return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Iterator[Patterns]]:
    """The number of blocks and their tables one after the other; a block has about ``block_chars`` characters, whatever the benchmark's size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))

    def tables():
        for block in range(n):
            rows = dealt.where(F.col("block") == block).collect()
            yield Patterns([(r["item"], None if r["text"] is None else r["text"].encode()) for r in rows])

    return n, tables()


def _result(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> dict:
    n_hit = sum(b - a for a, b in spans)
    return {"n_words": n_words, "n_hit": n_hit, "n_items": len(items),
            "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
            "contaminated": n_hit > 0 and 20 * n_hit >= n_words}


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_PART = "doc_id long, text_key long, n_words long, spans array<long>, items array<string>"


def _table(rows: list[dict], **first) -> dict:
    return {**first, **{f: [r[f] for r in rows] for f in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}}


def _scanned(batch: pa.RecordBatch, tables: Patterns) -> list[dict]:
    found = []
    for text in as_bytes(batch, "text"):
        words = words_of(text)
        found.append(_result(len(words), *tables.search(words)))
    return found


def _partial(batch: pa.RecordBatch, tables: Patterns) -> dict:
    found = [(words, *tables.search(words)) for words in map(words_of, as_bytes(batch, "text"))]
    return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n_words": [len(w) for w, _, _ in found],
            "spans": [[x for span in spans for x in span] for _, spans, _ in found],
            "items": [sorted(items) for _, _, items in found]}


def _combined(batch: pa.RecordBatch) -> dict:
    rows = []
    for n_words, spans, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "spans", "items"))):
        rows.append(_result(n_words, merged(list(zip(spans[::2], spans[1::2]))), set(items)))
    return _table(rows, doc_id=batch.column("doc_id"), text_key=batch.column("text_key"))


def _over_blocks(docs: DataFrame, blocks: Iterator[Patterns]) -> DataFrame:
    """Results per distinct (doc_id, text) over several blocks: each scans all rows, their spans are united per text.

    A block's findings are written before the next block's tables are made, so the driver holds one block at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    parts = [pin(map_batches(rows, partial(_partial, tables=b), _PART), "block") for b in blocks]
    per_block = reduce(DataFrame.unionAll, [p.withColumn("block", F.lit(i)) for i, p in enumerate(parts)])
    once = per_block.dropDuplicates(["doc_id", "text_key", "block"])
    united = once.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return map_batches(united, _combined, RESULT.replace("doc_id long", "doc_id long, text_key long"))


def scan(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: its words, hit words, owning items and whether it is contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated when at least a twentieth of its
    words are. Null and empty texts have no words and aren't contaminated. Repeated rows each get a row;
    repeated items count once; an item with a null id is listed as ``null``; an empty benchmark hits nothing.
    """
    n, blocks = _blocks(benchmark, block_chars)
    if n == 1:  # the same rows without the uniting step
        tables = next(blocks)
        return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                           lambda b: _table(_scanned(b, tables), doc_id=b.column("doc_id")), RESULT)
    keys = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    found = _over_blocks(docs, blocks)
    return keys.join(found, same(keys, ["id", "key"], ["doc_id", "text_key"])).drop("id", "key", "text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    Null and empty texts stay, as do repeated rows that are clean; an empty benchmark or table drops nothing.
    """
    n, blocks = _blocks(benchmark, block_chars)
    if n == 1:
        tables = next(blocks)

        def clean(batches):
            for batch in batches:
                yield batch.filter(pa.array([not r["contaminated"] for r in _scanned(batch, tables)], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    bad = _over_blocks(docs, blocks).where("contaminated")
    id_, key, mark = fresh(docs, "bad_id"), fresh(docs, "bad_key"), fresh(docs, "text_hash")
    bad = bad.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    tagged = docs.withColumn(mark, F.xxhash64("text"))
    return tagged.join(bad, same(docs, ["doc_id", mark], [id_, key]), "left_anti").select(*[quoted(c) for c in docs.columns])
