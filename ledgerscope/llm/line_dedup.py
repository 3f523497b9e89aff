"""Line dedup by winnowing over line hashes.

A text is the sequence of its non-blank lines, stripped of white space at both ends. Grams of ``GRAM`` lines are hashed;
of every ``WINDOW`` neighbouring grams the smallest hash (the last of equals) is a fingerprint. Whatever run of
``RUN = WINDOW + GRAM - 1`` lines is repeated has its fingerprint repeated at the same place, so only fingerprints that
occur more than once are joined. From each joined position the match is extended to the left and right through
all windows of RUN lines that chose it, each compared with its earliest equal; matching windows chain
into runs of any length, and later occurrences of a run are deleted.

A line may be a whole paragraph. ``drop_repeated_lines`` therefore also takes runs of fewer lines that have more than
``LONG`` words: each is its own fingerprint. ``report`` has runs of RUN lines only, as its SQL says.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import as_bytes, fresh, map_batches, quoted, same
from ledgerscope.session import pin

GRAM, WINDOW = 2, 2
RUN = WINDOW + GRAM - 1
LONG = 50
_BLANK = b" \t\r\x0b\x0c"


def _lines(text: bytes | None) -> tuple[list[bytes], list[int]]:
    """All lines, and the numbers of those that aren't blank."""
    lines = (text or b"").split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip(_BLANK)]


def _chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbouring values."""
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i:n + i]
    return out


def selected(hashes: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """Fingerprints of a text: (gram position, gram hash, starts of the windows that chose it)."""
    if len(hashes) < RUN:
        return []
    grams = _chained(hashes, GRAM)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = np.arange(len(views)) + WINDOW - 1 - np.argmin(views[:, ::-1], axis=1)
    chosen: dict[int, list[int]] = {}
    for start, p in enumerate(at.tolist()):
        chosen.setdefault(p, []).append(start)
    return [(p, int(grams[p]), starts) for p, starts in chosen.items()]


def _signed(values) -> list[int]:
    return np.asarray(values, np.uint64).view(np.int64).tolist()


def long_runs(lines: list[bytes], hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of fewer than RUN lines with more than ``LONG`` words: (size, start, hash)."""
    words = np.concatenate([[0], np.cumsum([len(line.split()) for line in lines])]).astype(np.int64)
    out = []
    for size in range(1, min(RUN, len(lines) + 1)):
        at = np.flatnonzero(words[size:] - words[:-size] > LONG)
        if len(at):
            chained = _chained(hashes, size)
            out += [(size, s, int(chained[s])) for s in at.tolist()]
    return out


_PRINTS = "doc_id long, text_key long, gram long, size long, starts array<long>, runs array<long>"


def _prints(batch: pa.RecordBatch, short: bool) -> dict:
    out: dict[str, list] = {c.split()[0]: [] for c in _PRINTS.split(", ")}
    for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), as_bytes(batch, "text")):
        lines, kept = _lines(text)
        hashes = np.array([xxhash.xxh64_intdigest(lines[i].strip(_BLANK)) for i in kept], np.uint64)
        if len(hashes) >= RUN:
            runs = _signed(_chained(hashes, RUN))
            for _, gram, starts in selected(hashes):
                for name, value in (("doc_id", doc), ("text_key", key), ("gram", _signed([gram])[0]), ("size", RUN), ("starts", starts),
                                    ("runs", [runs[s] for s in starts])):
                    out[name].append(value)
        if short:
            for size, start, run in long_runs([lines[i] for i in kept], hashes):
                run = _signed([run])[0]
                for name, value in (("doc_id", doc), ("text_key", key), ("gram", run), ("size", size), ("starts", [start]), ("runs", [run])):
                    out[name].append(value)
    return out


def repeated_windows(docs: DataFrame, short: bool = False) -> DataFrame:
    """``(doc_id, text_key, windows)``: per distinct text of an id, the windows (start, size) that occur earlier.

    Windows are all runs of RUN lines and, with ``short``, those of fewer lines with more than ``LONG`` words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    prints = pin(map_batches(rows, lambda batch: _prints(batch, short), _PRINTS), "prints")
    shared = prints.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    joined = prints.join(shared, "gram", "left_semi")
    windows = joined.select("doc_id", "text_key", "size", F.explode(F.arrays_zip("starts", "runs")).alias("w")).select(
        "size",
        F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"),
                 F.col("w.starts").alias("start")).alias("place"), F.col("w.runs").alias("run"))
    first = windows.groupBy("size", "run").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    later = windows.join(first.select("size", "run", "first"), ["size", "run"]).where("place > first")
    return later.groupBy(F.col("place.id").alias("doc_id"), F.col("place.key").alias("text_key")).agg(
        F.array_distinct(F.collect_list(F.struct("place.start", "size"))).alias("windows"))


def without(text: bytes | None, windows: list[dict] | None) -> tuple[bytes | None, int, int, int]:
    """The text without the lines of the given windows; its non-blank lines, how many went, in how many runs."""
    lines, kept = _lines(text)
    if not windows:
        return text, len(kept), 0, 0
    gone = sorted({w["start"] + i for w in windows for i in range(w["size"])})
    runs = 1 + sum(b - a > 1 for a, b in zip(gone, gone[1:]))
    numbers = {kept[i] for i in gone}
    return b"\n".join(line for i, line in enumerate(lines) if i not in numbers), len(kept), len(gone), runs


_RESULT = "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string"


def _report(batch: pa.RecordBatch) -> dict:
    rows = [without(t, s) for t, s in zip(as_bytes(batch, "text"), batch.column("windows").to_pylist())]
    return {"doc_id": batch.column("doc_id"), "n_lines": [r[1] for r in rows], "n_removed": [r[2] for r in rows],
            "n_runs": [r[3] for r in rows], "kept_sha256": [hashlib.sha256(r[0] or b"").hexdigest() for r in rows]}


def _marked(docs: DataFrame, short: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with its repeated windows in an extra column."""
    found = repeated_windows(docs, short)
    key, id_, hash_, windows = (fresh(docs, n) for n in ("text_hash", "run_id", "run_hash", "run_windows"))
    found = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(hash_), F.col("windows").alias(windows))
    joined = docs.withColumn(key, F.xxhash64("text")).join(found, same(docs, ["doc_id", key], [id_, hash_]), "left")
    return joined.select(*[quoted(c) for c in docs.columns], windows), windows


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: non-blank lines, lines removed, maximal removed runs, SHA-256 of what is kept.

    A line goes when it is in a run of three or more lines that also starts earlier, in the order of doc_id
    (null last), text hash and line; runs are judged on the input. Texts of fewer lines stay whole, null counts as
    empty. Rows that repeat both id and text are one document and get the same result.
    """
    marked, windows = _marked(docs.select("doc_id", "text"))
    return map_batches(marked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(windows).alias("windows")),
                       _report, _RESULT)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeated runs cut from the texts and ``n_chars`` set anew where it is a column.

    Runs have three or more lines, or more than ``LONG`` words in fewer.
    Rows of which no non-blank line is left go; texts that were blank or null before stay as they are.
    """
    marked, windows = _marked(docs, short=True)
    names, schema = docs.columns, docs.schema

    def cut(batches):
        for batch in batches:
            texts = as_bytes(batch, "text")
            rows = [without(t, s) for t, s in zip(texts, batch.column(windows).to_pylist())]
            kept = [r[2] == 0 or r[2] < r[1] for r in rows]
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array([None if r[0] is None else r[0].decode() for r in rows], batch.schema.field("text").type)
            if "n_chars" in columns:
                old = batch.column("n_chars").to_pylist()
                columns["n_chars"] = pa.array([len(r[0].decode()) if r[2] else n for r, n in zip(rows, old)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(kept, pa.bool_()))

    return marked.mapInArrow(cut, schema)
