"""Secret scan: fixed expressions and a battery of randomness tests with false-discovery control.

Base expressions find assignments to names such as ``password``, access key ids and long hexadecimal runs. Beside them every
run of key-like characters is a candidate. Its encoding is inferred as the smallest alphabet that holds it, and three tests ask
whether its symbols could be independent and uniform over that alphabet: chi-squared over the symbols, the number of runs of
character classes, and the serial correlation of symbol numbers. Fisher's sum joins their p-values.

Passing the battery is not enough, since short ordinary strings pass too. Against them each candidate gets ``DECOYS``
strings of its own length and alphabet, made of the prose around it. Per encoding and length class, the share of decoys
that look as random as the candidates estimates how many candidates of that class are ordinary; a candidate is
reported where that false-discovery rate is at most ``RATE``. Distinct candidates count once, over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.shared import arrow_schema, fresh, quoted, same
from ledgerscope.session import pin

KINDS = ("assign", "access", "hex")
#: Symbols times log2 of the alphabet: what a candidate must be able to hold.
BITS = 80
SHORTEST = 14
DECOYS = 20
RATE = 0.05
#: A candidate whose joint p-value is below this isn't random.
ALPHA = 0.001
LAST_BIN = 90
BIN = 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run is long enough or is dropped, so this finds what + and a check would
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:={1,2})?" % SHORTEST)

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by name, smaller before larger ones that hold them.
ALPHABETS = {
    "decimal": _DIGITS, "hex": _DIGITS + _LOWER[:6], "upper hex": _DIGITS + _UPPER[:6], "lower": _LOWER, "upper": _UPPER,
    "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "upper base36": _DIGITS + _UPPER, "letters": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
_OTHERS = {name: re.compile(f"[^{re.escape(a)}]+") for name, a in ALPHABETS.items()}


def _classes(alphabet: str) -> np.ndarray:
    """The class of each symbol: digit, lower, upper or other; the halves of an alphabet that has one class only."""
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in alphabet]
    return np.array(kinds if len(set(kinds)) > 1 else [int(2 * i >= len(alphabet)) for i in range(len(alphabet))], np.int8)


_PLACES = {}
for _name, _alphabet in ALPHABETS.items():
    _PLACES[_name] = np.zeros(128, np.int16)
    _PLACES[_name][[ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
_CLASSES = {name: _classes(a) for name, a in ALPHABETS.items()}


# ---- the battery --------------------------------------------------------------------------------

def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution, never quite zero."""
    return np.array([min(max(math.erfc(v / math.sqrt(2)) / 2, 1e-300), 1.0) for v in z.tolist()])


def uniformity(x: np.ndarray, k: int) -> np.ndarray:
    """Chi-squared p-value per row, by a gamma distribution with the exact mean and variance for few symbols."""
    n = x.shape[1]
    counts = np.zeros((len(x), k))
    np.add.at(counts, (np.arange(len(x))[:, None], x), 1)
    found = ((counts - n / k) ** 2).sum(1) * k / n
    mean, var = k - 1, 2 * (k - 1) * (1 - 1 / n)
    freedom = 2 * mean * mean / var
    z = (np.cbrt(found / mean) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom))
    return _tail(z)


def runs(x: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Two-sided p-value of the number of changes of class between neighbours."""
    n = x.shape[1]
    share = np.bincount(classes) / len(classes)
    change = 1 - (share ** 2).sum()
    both = 1 - 2 * (share ** 2).sum() + (share ** 3).sum()
    var = (n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change * change)
    seen = (np.diff(classes[x].astype(np.int8), axis=1) != 0).sum(1)
    return np.minimum(1.0, 2 * _tail(np.abs(seen - (n - 1) * change) / np.sqrt(max(var, 1e-9))))


def serial(x: np.ndarray, k: int) -> np.ndarray:
    """Two-sided p-value of the correlation between neighbouring symbol numbers."""
    y = (x - (k - 1) / 2) / np.sqrt((k * k - 1) / 12)
    return np.minimum(1.0, 2 * _tail(np.abs((y[:, 1:] * y[:, :-1]).sum(1)) / np.sqrt(x.shape[1] - 1)))


def fisher(x: np.ndarray, encoding: str) -> np.ndarray:
    """Minus twice the summed logarithms of the three p-values; chi-squared with six degrees of freedom if random."""
    k = len(ALPHABETS[encoding])
    return -2 * (np.log(uniformity(x, k)) + np.log(runs(x, _CLASSES[encoding])) + np.log(serial(x, k)))


def joint(statistic: float) -> float:
    """The p-value of Fisher's sum."""
    half = statistic / 2
    return float(np.exp(-half) * (1 + half + half * half / 2))


def encoding_of(token: str) -> tuple[str, str] | None:
    """The smallest alphabet of a token and its symbols; dashes between hexadecimal groups are left out. None if it holds too little."""
    body = token.rstrip("=")
    bare = body.replace("-", "").replace("_", "")
    for symbols, names in ((bare, ("decimal", "hex", "upper hex")), (body, ALPHABETS)):
        held = set(symbols)
        for name in names:
            if held <= _SETS[name]:
                return (name, symbols) if len(symbols) > 2 and len(symbols) * np.log2(len(ALPHABETS[name])) >= BITS else None
    return None


def length_class(n: int) -> int:
    """The smallest length of its class: two classes to a power of two."""
    power = 1 << (n.bit_length() - 1)
    return power + power // 2 if n >= power + power // 2 else power


def _numbers(symbols: str, encoding: str) -> np.ndarray:
    return _PLACES[encoding][np.frombuffer(symbols.encode("ascii"), np.uint8)]


def _bins(rows: list[np.ndarray], encoding: str) -> list[int]:
    """Binned Fisher sums of rows of one length; long ones are taken a few at a time."""
    step, out = max(1, 100_000 // len(rows[0])), []
    for i in range(0, len(rows), step):
        out += np.minimum(fisher(np.array(rows[i:i + step]), encoding) / BIN, LAST_BIN).astype(int).tolist()
    return out


def decoys(prose: str, n: int) -> list[str]:
    """``DECOYS`` stretches of ``n`` symbols spread over the prose, which is repeated where it is too short."""
    if len(prose) <= n:
        prose = prose * (n // len(prose) + 2)
    return [prose[at:at + n] for at in ((len(prose) - n) * j // DECOYS for j in range(DECOYS))]


# ---- spans --------------------------------------------------------------------------------------

def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) in code points, by start and then kind; matches that fail their check are dropped."""
    out = []
    small = text.encode("utf-8", "surrogatepass").lower()
    if any(name in small for name in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _uncovered(text: str, spans: list[tuple[str, int, int]]):
    """Candidates that no base span holds whole."""
    reach, i = [], 0
    for _, a, b in spans:
        reach.append((a, max(b, reach[-1][1] if reach else 0)))
    for m in _CANDIDATE.finditer(text):
        while i < len(reach) and reach[i][0] <= m.start():
            i += 1
        if not (i and reach[i - 1][1] >= m.end()):
            yield m


def candidates(text: str, spans: list[tuple[str, int, int]]):
    """(start, end, hash, class, bin, bins of decoys or None) of every candidate; a text without prose gives none of the latter."""
    found = [(m, e) for m in _uncovered(text, spans) if (e := encoding_of(m.group()))]
    if not found:
        return
    masked, at = [], 0
    for m in _CANDIDATE.finditer(text):
        masked.append(text[at:m.start()])
        at = m.end()
    masked.append(text[at:])
    rest, prose = " ".join(masked), {}
    for m, (encoding, symbols) in found:
        if encoding not in prose:
            prose[encoding] = _OTHERS[encoding].sub("", rest)
        rows = [symbols, *(decoys(prose[encoding], len(symbols)) if prose[encoding] else [])]
        bins = _bins([_numbers(r, encoding) for r in rows], encoding)
        token = xxhash.xxh64_intdigest(m.group().encode("ascii")) - (1 << 63)
        yield m.start(), m.end(), token, f"{encoding}:{length_class(len(symbols))}", bins[0], bins[1:] or None


_FOUND = ("doc_id long, text_key long, base string, n_assign long, n_access long, n_hex long, token long, class string, bin long, "
          "decoys array<long>, start long, end long")
_COLUMNS = [c.split()[0] for c in _FOUND.split(", ")]


def _scan(batches):
    """One row per document with its base spans and one per candidate, whose ``base`` is null."""
    schema = arrow_schema(_FOUND)
    for batch in batches:
        out = []
        for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
            text = text or ""
            spans = base_spans(text)
            counts = Counter(k for k, _, _ in spans)
            out.append({"doc_id": doc, "text_key": key, "base": listed(spans), **{f"n_{k}": counts[k] for k in KINDS}})
            out += [{"doc_id": doc, "text_key": key, "start": a, "end": b, "token": token, "class": c, "bin": n, "decoys": d}
                    for a, b, token, c, n, d in candidates(text, spans)]
        yield pa.RecordBatch.from_pydict({c: [r.get(c) for r in out] for c in _COLUMNS}, schema=schema)


def thresholds(tokens: DataFrame) -> DataFrame:
    """Per class the largest bin whose estimated false-discovery rate is at most ``RATE``.

    ``tokens(class, bin, decoys)``: one row per distinct candidate. A class is an encoding and a power of two or half of one, and has
    at most ``LAST_BIN`` + 1 bins, so the tables behind the window are small at any input.
    """
    here = tokens.where(F.col("decoys").isNotNull())
    counts = here.select("class", F.col("bin"), F.lit(1).alias("hit"), F.lit(0).alias("decoy")).unionAll(
        here.select("class", F.explode("decoys"), F.lit(0), F.lit(1))).groupBy("class", "bin").agg(F.sum("hit").alias("hit"), F.sum("decoy").alias("decoy"))
    upto = Window.partitionBy("class").orderBy("bin")
    rate = (1 + F.sum("decoy").over(upto)) / (DECOYS * F.greatest(F.lit(1), F.sum("hit").over(upto)))
    return counts.select("class", "bin", rate.alias("rate")).where(F.col("rate") <= RATE).groupBy("class").agg(F.max("bin").alias("most"))


def _last_random() -> int:
    """The last bin that isn't rejected by the battery."""
    return max(b for b in range(LAST_BIN) if joint(BIN * (b + 1)) >= ALPHA)


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, text_key, n_assign, n_access, n_hex, base, spans``.

    ``base`` and ``spans`` list kind:start:end, comma-joined, by start and then kind; ``spans`` adds random strings, as kind
    ``random``, where no base span holds them whole. Null counts as empty. Repeated rows each get a row, and a string counts once
    in the rates however often it stands. A string in a text without prose is judged by the rates of its class.
    Very long strings are tested whole. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    found = pin(rows.mapInArrow(_scan, _FOUND), "scanned")
    base = found.where(F.col("base").isNotNull()).select("doc_id", "text_key", "base", *[f"n_{k}" for k in KINDS])
    strings = found.where(F.col("base").isNull())
    tokens = strings.groupBy("token", "class").agg(F.min(F.struct(F.col("decoys").isNull().alias("none"), "bin", "decoys")).alias("t"))
    limits = thresholds(tokens.select("class", "t.bin", "t.decoys"))
    hits = strings.join(F.broadcast(limits), "class").where(F.col("bin") <= F.least("most", F.lit(_last_random())))
    hits = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(
        F.array_sort(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("order"), F.lit("random").alias("kind"), "end"))).alias("hits"))
    joined = base.join(hits, same(base, ["doc_id", "text_key"], ["hit_id", "hit_key"]), "left")
    parts = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    own = F.transform(parts, lambda p: F.struct(p[1].cast("long").alias("start"), order[p[0]].alias("order"), p[0].alias("kind"), p[2].cast("long").alias("end")))
    spans = F.when(F.col("hits").isNull(), F.col("base")).otherwise(_text_of(F.array_sort(F.concat(own, F.col("hits")))))
    return joined.select("doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"))


def masked(text: str, spans: str) -> str:
    """The text with every span replaced by a mark of its kind; of overlapping spans the first names it and all are hidden."""
    out, at = [], 0
    for item in filter(None, spans.split(",")):
        kind, a, b = item.split(":")
        if int(a) >= at:
            out += [text[at:int(a)], f"[{kind.upper()}]"]
        at = max(at, int(b))
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all secrets masked; all columns stay, null texts stay null."""
    found = find(docs).groupBy("doc_id", "text_key").agg(F.first("spans").alias("spans"))
    key, id_, hash_, spans = (fresh(docs, n) for n in ("text_hash", "found_id", "found_hash", "found_spans"))
    found = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(hash_), F.col("spans").alias(spans))
    joined = docs.withColumn(key, F.xxhash64("text")).join(found, same(docs, ["doc_id", key], [id_, hash_]), "left")
    joined = joined.select(*[quoted(c) for c in docs.columns], spans)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            texts = [t if t is None else masked(t, s or "") for t, s in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist())]
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``find`` with the SHA-256 of ``base`` in its place."""
    return find(docs).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
