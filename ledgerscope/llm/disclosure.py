"""Information-theoretic sanitisation of personal data.

Base detectors find e-mail addresses, IP addresses, card and phone numbers: the protected entities. Words near an entity
can give it away as well. How strongly a term reveals an entity is estimated from the whole corpus: their pointwise mutual
information, log2(n_te * N / (n_t * n_e)), as a share of the entity's own information, log2(N / n_e), where n count documents
that hold the term, the entity, and the term within ``REACH`` words of the entity. At ``GENERALISE`` of the entity's
information or more a term near it is replaced by its kind of word, at ``REMOVE`` or more by a mark. A pair seen in
fewer than ``SUPPORT`` different surroundings is judged by a lower bound: n_te / n_t, the chance of the entity given the term, is
replaced by the lower end of its Wilson interval (``Z``) over as many trials as there would be if copies of one passage were one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import arrow_schema, fresh, quoted, same
from ledgerscope.session import pin

REACH = 6
SUPPORT = 3
Z = 1.645
GENERALISE, REMOVE = 0.8, 0.95
FLUSH = 300_000
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    """Each ``@`` has one possible local part, the run before it, so the search is linear in the text."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) in code points, by kind and then start; matches that fail their check are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") for part in m.group().split(".")]  # int() refuses thousands of digits
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _near(text: str, spans: list[tuple[str, int, int]], reach: int):
    """Per base span: its entity, a hash of its surroundings, and the terms near it with their places."""
    terms = list(_TERM.finditer(text)) if spans else []
    starts, ends = [m.start() for m in terms], [m.end() for m in terms]
    covered, done = set(), 0
    for a, b in sorted((a, b) for _, a, b in spans):  # ``done`` keeps overlapping spans from being gone over again
        first, last = max(done, bisect_right(ends, a)), bisect_left(starts, b)
        covered.update(range(first, last))
        done = max(done, last)
    for kind, a, b in spans:
        entity = xxhash.xxh64_intdigest(f"{kind}:{text[a:b].lower()}".encode("utf-8", "surrogatepass")) - (1 << 63)
        left, right = bisect_right(ends, a), bisect_left(starts, b)
        near = [*range(max(0, left - reach), left), *range(right, min(len(terms), right + reach))]
        found = [(terms[i].group().lower(), starts[i], ends[i]) for i in near if i not in covered]
        around = xxhash.xxh64_intdigest(" ".join(t[0] for t in found).encode("utf-8", "surrogatepass")) - (1 << 63)
        yield entity, around, found


_GATHERED = ("part int, doc_id long, text_key long, base string, n_email long, n_ip long, n_card long, n_phone long, "
             "entity long, around long, term string, n long, start long, end long")
_NAMES = [c.split()[0] for c in _GATHERED.split(", ")]
_DOC, _CONTEXT, _ENTITY, _TERMS = range(4)


def _gather(batches, reach: int = REACH):
    """One pass over the texts: base spans of every document, terms near entities, entities, and documents per term."""
    schema, seen = arrow_schema(_GATHERED), Counter()

    def page(rows):
        return pa.RecordBatch.from_pydict({c: [r.get(c) for r in rows] for c in _NAMES}, schema=schema)

    for batch in batches:
        out = []
        for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
            text = text or ""
            spans = base_spans(text)
            counts = Counter(k for k, _, _ in spans)
            out.append({"part": _DOC, "doc_id": doc, "text_key": key, "base": listed(spans), **{f"n_{k}": counts[k] for k in KINDS}})
            seen.update(set(_TERM.findall(text.lower())))
            entities, pairs = set(), set()
            for entity, around, found in _near(text, spans, reach):
                if entity not in entities:
                    entities.add(entity)
                    out.append({"part": _ENTITY, "entity": entity})
                for term, start, end in found:
                    new = (entity, term) not in pairs
                    pairs.add((entity, term))
                    out.append({"part": _CONTEXT, "doc_id": doc, "text_key": key, "entity": entity, "around": around, "term": term, "n": int(new),
                                "start": start, "end": end})
        yield page(out)
        if len(seen) > FLUSH:
            yield page([{"part": _TERMS, "term": t, "n": n} for t, n in seen.items()])
            seen.clear()
    if seen:
        yield page([{"part": _TERMS, "term": t, "n": n} for t, n in seen.items()])


def _lower(chance: Column, trials: Column) -> Column:
    """The lower end of the Wilson interval of a share of ``trials``."""
    z2 = Z * Z
    spread = Z * F.sqrt(chance * (1 - chance) / trials + z2 / (4 * trials * trials))
    return (chance + z2 / (2 * trials) - spread) / (1 + z2 / trials)


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, text_key, n_email, n_ip, n_card, n_phone, base, spans, revealing``.

    ``base`` and ``spans`` list kind:start:end, comma-joined, ordered by kind and start; ``spans`` adds terms, as
    kind ``term``. ``revealing`` holds start:end:share of those terms. Null counts as empty. Repeated rows each get a row and count
    each in the statistics. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    gathered = pin(rows.mapInArrow(_gather, _GATHERED), "gathered")
    base = gathered.where(F.col("part") == _DOC).select("doc_id", "text_key", "base", *[f"n_{k}" for k in KINDS])
    contexts = gathered.where(F.col("part") == _CONTEXT)
    seen = contexts.groupBy("entity", "term", "around").agg(F.sum("n").alias("n"))
    pairs = seen.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("around"))
    entities = gathered.where(F.col("part") == _ENTITY).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    terms = gathered.where(F.col("part") == _TERMS).groupBy("term").agg(F.sum("n").alias("n_t"))
    total = base.agg(F.count(F.lit(1)).alias("n_all"))
    known = pairs.join(entities, "entity").join(terms, "term").join(F.broadcast(total))
    own = F.log2(F.col("n_all") / F.col("n_e"))
    chance = F.col("n_te") / F.col("n_t")
    judged = F.when(F.col("around") >= SUPPORT, chance).otherwise(_lower(chance, F.col("around") / chance))
    share = F.when(own > 0, F.log2(judged * F.col("n_all") / F.col("n_e")) / own).otherwise(0.0)
    strong = known.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)
    hits = contexts.select("doc_id", "text_key", "entity", "term", "start", "end").join(strong, ["entity", "term"])
    hits = hits.groupBy("doc_id", "text_key", "start", "end").agg(F.max("share").alias("share"))
    told = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("hits"))
    joined = base.join(told, same(base, ["doc_id", "text_key"], ["hit_id", "hit_key"]), "left")
    text = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", F.lit("term"), h["start"].cast("string"), h["end"].cast("string"))), ",")
    shares = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["start"].cast("string"), h["end"].cast("string"), F.round(h["share"], 4).cast("string"))), ",")
    return joined.select("doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base",
                         F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(text != "", text)).alias("spans"),
                         F.coalesce(shares, F.lit("")).alias("revealing"))


def _kind_of_word(word: str) -> str:
    return "NAME" if word[:1].isupper() else "WORD"


def rewritten(text: str, base: str, revealing: str) -> str:
    """The text with base spans and strongly revealing terms replaced by marks, others by their kind of word."""
    marks = []
    for item in filter(None, base.split(",")):
        kind, a, b = item.split(":")
        marks.append((int(a), int(b), f"[{kind.upper()}]"))
    for item in filter(None, revealing.split(",")):
        a, b, share = item.split(":")
        marks.append((int(a), int(b), "[TERM]" if float(share) >= REMOVE else f"[{_kind_of_word(text[int(a):int(b)])}]"))
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every text rewritten; all columns stay, null texts stay null."""
    found = find(docs).groupBy("doc_id", "text_key").agg(F.first("base").alias("base"), F.first("revealing").alias("revealing"))
    key, id_, hash_, base, shares = (fresh(docs, n) for n in ("text_hash", "found_id", "found_hash", "found_base", "found_terms"))
    found = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(hash_), F.col("base").alias(base), F.col("revealing").alias(shares))
    joined = docs.withColumn(key, F.xxhash64("text")).join(found, same(docs, ["doc_id", key], [id_, hash_]), "left")
    joined = joined.select(*[quoted(c) for c in docs.columns], base, shares)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            texts = [t if t is None else rewritten(t, b or "", s or "")
                     for t, b, s in zip(*(batch.column(c).to_pylist() for c in ("text", base, shares)))]
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``find`` with the SHA-256 of ``base`` in its place."""
    return find(docs).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
