"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public byte-level vocabulary. The probability of a word is
the sum over all its segmentations into pieces, by the forward algorithm; pieces don't cross words, so a text's is the product
over its words and all segmentations of the text are summed. Words of any length are summed whole: long ones in logarithms, block
by block, with the sums of the last places carried on. Expectation maximisation fits the probabilities to the words of
a bounded sample: ``FIT_DOCS`` whole documents of each language, those with the smallest id hashes. Their words are counted by Spark, and only the
fit takes words of more than ``STRETCH`` bytes in stretches of that length.
"""

from __future__ import annotations

import base64
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.shared import arrow_schema, map_batches
from ledgerscope.llm.toxicity import held_out
from ledgerscope.session import pin

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FIT_DOCS = 1500
#: Longest stretch of which probabilities can be multiplied without running out of the range of a double.
STRETCH = 36
BLOCK = 1 << 15
ROUNDS, FLOOR = 4, 0.01
_BREAKS = {c: " " for c in range(128) if not chr(c).isalpha()}
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; in ASCII only letters belong to words."""
    return (text or "").lower().translate(_BREAKS).split()


def as_pieces(word: str) -> bytes:
    """A word as the vocabulary has it, after a space."""
    return b" " + word.encode("utf-8", "surrogatepass")


def stretches(word: str) -> list[bytes]:
    """A word for the fit, in stretches of at most ``STRETCH`` bytes."""
    raw = as_pieces(word)
    return [raw[i:i + STRETCH] for i in range(0, len(raw), STRETCH)]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """All pieces of a rank file; every single byte is among them."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    return sorted(pieces - {b""} | {bytes([b]) for b in range(256)})


class Lattice:
    """All pieces at all places of many equally long stretches."""

    def __init__(self, names: np.ndarray, order: np.ndarray, raw: np.ndarray, longest: int) -> None:
        n, self.size = raw.shape
        self.longest = longest
        self.at = {}
        codes = _BYTES[raw]
        for length in range(1, min(longest, self.size) + 1):
            name = np.full((n, self.size - length + 1), length, np.uint64)
            for i in range(length):
                name = name * _MUL + codes[:, i:self.size - length + 1 + i]
                name ^= name >> np.uint64(31)
            place = np.minimum(np.searchsorted(names, name), len(names) - 1)
            self.at[length] = np.where(names[place] == name, order[place], len(names)).astype(np.int32)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over segmentations of every prefix: (stretches, size + 1, languages)."""
        n = len(self.at[1])
        alpha = np.zeros((n, self.size + 1, p.shape[1]))
        alpha[:, 0] = 1
        for end in range(1, self.size + 1):
            for length in range(1, min(self.longest, end) + 1):
                alpha[:, end] += alpha[:, end - length] * p[self.at[length][:, end - length]]
        return alpha

    def expected(self, p: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
        """Add the expected piece counts, stretches weighted by ``counts(stretches, languages)``, to ``total``."""
        alpha, beta = self.forward(p), np.zeros((len(counts), self.size + 1, p.shape[1]))
        beta[:, self.size] = 1
        for start in range(self.size - 1, -1, -1):
            for length in range(1, min(self.longest, self.size - start) + 1):
                beta[:, start] += beta[:, start + length] * p[self.at[length][:, start]]
        weight = counts / np.maximum(beta[:, 0], 1e-300)
        for start in range(self.size):
            for length in range(1, min(self.longest, self.size - start) + 1):
                piece = self.at[length][:, start]
                hit = np.flatnonzero(piece < len(p) - 1)
                np.add.at(total, piece[hit], (alpha[hit, start] * p[piece[hit]] * beta[hit, start + length] * weight[hit]))


@dataclass
class Model:
    languages: list[str]
    names: np.ndarray
    order: np.ndarray
    p: np.ndarray  # (pieces + 1, languages); the last row is for places without a piece
    prior: np.ndarray
    longest: int

    def log_long(self, raw: bytes) -> np.ndarray:
        """Log probabilities of one word of any length, per language. Memory is that of a block, whatever the length."""
        with np.errstate(divide="ignore"):
            logs = np.log(self.p)
        data, far, reach = np.frombuffer(raw, np.uint8), len(self.p) - 1, self.longest
        sums = np.full((reach, len(self.languages)), -np.inf)  # of the last ``reach`` places
        sums[-1] = 0
        for start in range(0, len(data), BLOCK):
            first, stop = max(0, start - reach + 1), min(len(data), start + BLOCK)
            lattice = Lattice(self.names, self.order, data[None, first:stop], reach)
            piece = np.full((stop - start, reach), far)  # by end and length, the longest first
            for length, at in lattice.at.items():
                ends = np.arange(first + length, stop + 1)
                inside = ends > start
                piece[ends[inside] - start - 1, reach - length] = at[0][inside]
            block = np.vstack([sums, np.full((stop - start, sums.shape[1]), -np.inf)])
            for i in range(stop - start):
                terms = block[i:i + reach] + logs[piece[i]]
                top = terms.max(axis=0)
                block[i + reach] = top + np.log(np.exp(terms - top).sum(axis=0))
            sums = block[-reach:]
        return sums[-1]

    def lattices(self, parts: list[bytes], most: int = 20_000):
        """Lattices of stretches grouped by length, with the numbers of the stretches in them."""
        by_size: dict[int, list[int]] = {}
        for i, part in enumerate(parts):
            by_size.setdefault(len(part), []).append(i)
        for size, numbers in by_size.items():
            for at in range(0, len(numbers), most):
                some = numbers[at:at + most]
                raw = np.frombuffer(b"".join(parts[i] for i in some), np.uint8).reshape(len(some), size)
                yield np.array(some), Lattice(self.names, self.order, raw, self.longest)

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log probabilities (words, languages), all segmentations summed."""
        raw = [as_pieces(w) for w in words]
        short = [i for i, r in enumerate(raw) if len(r) <= STRETCH]
        out = np.zeros((len(words), len(self.languages)))
        for numbers, lattice in self.lattices([raw[i] for i in short]):
            out[np.array(short)[numbers]] = np.log(np.maximum(lattice.forward(self.p)[:, -1], 1e-300))
        for i in set(range(len(words))) - set(short):
            out[i] = self.log_long(raw[i])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The most probable language of each text and its probability; ``und`` and 0 for texts without a letter."""
        index: dict[str, int] = {}
        lettered = [has_letter(t) and bool(self.languages) for t in texts]
        numbers = [[index.setdefault(w, len(index)) for w in words_of(t)] if ok else [] for t, ok in zip(texts, lettered)]
        logs = self.log_words(list(index)) if index else None
        names, scores = [], []
        for ok, own in zip(lettered, numbers):
            if not ok:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.prior + (logs[own].sum(axis=0) if own else 0)
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def train(texts: list[str], languages: list[str], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over the words of texts."""
    counts: dict[str, Counter] = {x: Counter() for x in set(languages)}
    for text, language in zip(texts, languages):
        counts[language].update(words_of(text))
    return fit(counts, Counter(languages), pieces, rounds)


def fit(words: dict[str, dict[str, int]], documents: dict[str, int], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Expectation maximisation from equal piece probabilities, over counts of words and of documents per language."""
    found = sorted(documents)
    hashes = []
    for piece in pieces:
        name = len(piece)
        for b in piece:
            name = (name * int(_MUL) + int(_BYTES[b])) & (1 << 64) - 1
            name ^= name >> 31
        hashes.append(name)
    names = np.array(hashes, np.uint64)
    order = np.argsort(names)
    prior = np.log(np.array([documents[x] for x in found], float) / max(1, sum(documents.values())))
    p = np.vstack([np.full((len(pieces), len(found)), 1 / len(pieces)), np.zeros((1, len(found)))])
    model = Model(found, names[order], order, p, prior, max(map(len, pieces)))
    index: dict[bytes, int] = {}
    at, column, times = [], [], []
    for k, language in enumerate(found):
        for word, n in sorted(words.get(language, {}).items()):
            for part in stretches(word):
                at.append(index.setdefault(part, len(index)))
                column.append(k)
                times.append(n)
    weights = np.zeros((len(index), len(found)))
    np.add.at(weights, (np.array(at, np.int64), np.array(column, np.int64)), np.array(times, float))
    lattices = [(weights[numbers], lattice) for numbers, lattice in model.lattices(list(index))] if found else []
    for _ in range(rounds):
        total = np.full((len(pieces) + 1, len(found)), FLOOR)
        for own, lattice in lattices:
            lattice.expected(model.p, own, total)
        total[-1] = 0
        model.p = total / np.maximum(total.sum(axis=0), 1e-300)
    return model


def sample(docs: DataFrame, per_language: int = FIT_DOCS) -> DataFrame:
    """``(id, language)`` of the bounded sample for the fit: of each language the documents with the smallest id hashes.

    Languages that have many documents are first cut to the hashes below a bound that leaves about twice as many as are wanted,
    so no task orders all documents of a language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.select(F.col("lang").cast("string").alias("language"), F.col("doc_id").alias("id")).distinct()
    placed = ids.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40))
    share = ids.groupBy("language").agg((F.lit(2.0 * per_language + 200) / F.count(F.lit(1))).alias("share"))
    near = placed.join(share, "language").where(F.col("place") <= F.col("share"))
    first = F.row_number().over(Window.partitionBy("language").orderBy("place", "id"))
    return near.withColumn("n", first).where(F.col("n") <= per_language).select("id", "language")


def learned(docs: DataFrame, pieces: list[bytes], per_language: int = FIT_DOCS) -> Model:
    """The model of the sample's whole texts. The driver gets the sample's distinct words with their counts."""
    ids = pin(sample(docs, per_language), "language_sample")
    rows = docs.select(F.col("doc_id").alias("own_id"), "text", F.col("lang").cast("string").alias("own"))
    texts = rows.join(ids, (F.col("own_id") == F.col("id")) & (F.col("own") == F.col("language"))).dropDuplicates(["id", "language", "text"])

    def counted(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for language, text in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(language, Counter()).update(words_of(text))
        rows_ = [(x, w, n) for x, counts in seen.items() for w, n in counts.items()]
        if rows_:
            yield pa.RecordBatch.from_pydict(dict(zip(("language", "word", "n"), zip(*rows_))), schema=arrow_schema("language string, word string, n long"))

    words: dict[str, dict[str, int]] = {}
    for r in texts.select("language", "text").mapInArrow(counted, "language string, word string, n long").groupBy("language", "word").agg(
            F.sum("n").alias("n")).collect():
        words.setdefault(r["language"], {})[r["word"]] = r["n"]
    documents = {r["language"]: r["count"] for r in ids.groupBy("language").count().collect()}
    return fit(words, documents, pieces)


RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: ``doc_id, held_out, lang_pred, score``.

    ``score`` is the probability of the predicted language among the learned ones. Texts that are null or have no letter are
    ``und`` with score 0, as are all texts if no language can be learned. Rows with a null id aren't learned from.
    Ties go to the language that sorts first; repeated rows each get a row.
    """
    model = learned(docs, read_vocabulary(vocabulary))

    def run(batch: pa.RecordBatch) -> dict:
        names, scores = model.predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": names, "score": scores}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_batches(rows, run, RESULT)
