"""SpotSigs document fingerprints, with DataFrame functions only.

At every anchor, a very common word, a spot signature begins: the anchor and the ``CHAIN`` content words after it, common words
between them passed over. The set of a text's hashed signatures is its fingerprint; boilerplate has few anchors, so prose
decides. A text without anchored chains takes every word as an anchor, so short or odd texts have a fingerprint
too. Sets are compared by Jaccard likeness. For a search, sets are partitioned by length: sets of likeness tau or more have
lengths within a factor tau, so only equal and neighbouring partitions meet, on their rarest signatures, and pairs
whose lengths already rule out tau are pruned before sets are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import pin

# Anchors, and the other common words that aren't content
ANCHORS = ["the", "a", "is", "that", "der", "die", "das", "ist", "le", "la", "est", "un", "el", "los", "es", "una"]
COMMON = ["of", "and", "to", "in", "it", "for", "on", "was", "with", "be", "as", "this", "by", "at", "are", "from", "or", "an",
          "und", "den", "von", "zu", "mit", "des", "sich", "auf", "im", "nicht", "dem", "ein", "eine", "als",
          "de", "et", "les", "en", "du", "une", "que", "pour", "qui", "dans", "au", "sur", "par", "pas", "avec",
          "y", "del", "se", "las", "por", "no", "con", "para", "su", "al", "lo"]
CHAIN = 2
REACH = 8
PER_BUCKET, MOST_BUCKETS = 2000, 16_384
_LEAST_ID = -(1 << 63)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column) -> Column:
    """The sorted set of a text's signature hashes (32 bits each, as longs); empty for a text without words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def chains(ws: Column) -> Column:
        n = F.size(ws)
        spots = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(ws, i - 1).isin(ANCHORS))

        def chain(i: Column) -> Column:
            content = F.filter(F.slice(ws, i + 1, REACH), lambda w: ~w.isin(ANCHORS + COMMON))
            return F.concat_ws(" ", F.get(ws, i - 1), F.slice(content, 1, CHAIN))

        anchored = F.transform(spots, chain)
        plain = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat_ws(" ", F.lit("*"), F.slice(ws, i, CHAIN)))
        return F.when(n == 0, F.array().cast("array<string>")).when(F.size(spots) > 0, anchored).otherwise(plain)

    found = F.transform(_bound(words, chains), lambda s: F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.array_sort(F.array_distinct(found))


def printed(signature_set: Column) -> Column:
    """A fingerprint as text: eight hex digits per signature."""
    return F.array_join(F.transform(signature_set, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - shared
    return F.when(whole == 0, F.lit(1.0)).otherwise(shared / whole)


def _bucketed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the bucket of their id, and per bucket the first id of the bucket after it (of the first, after the last).

    Bucket bounds are quantiles of the ids: at most ``MOST_BUCKETS`` numbers come to the driver, whatever the input.
    """
    ids = docs.select("id")
    n = ids.count()
    wanted = max(1, min(MOST_BUCKETS, n // PER_BUCKET))
    cuts = ids.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)], 2 * wanted).alias("c")).first()["c"] if wanted > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:  # how many bounds aren't above the id, by halving
        size = 1 << (len(cuts) - 1).bit_length()
        bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
        steps = F.array(*[F.lit(size >> i) for i in range(size.bit_length())])
        bucket = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(bounds, low + step - 1) <= F.col("id"), low + step).otherwise(low))
    rows = docs.withColumn("bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.min("id").alias("first_id"))
    line = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(line), F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows, firsts.select("first_id", before.alias("before"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the next document in ascending doc_id: ``doc_id, text, spots, next_text, next_spots``.

    Null ids come first, rows of equal ids follow each other by text hash, after the last row comes the first. Texts are
    shuffled once, by buckets of neighbouring ids; a copy of the first row of a bucket goes along with the bucket before.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, firsts = _bucketed(rows)
    firsts = pin(firsts, "firsts")  # one row per bucket, so its size has a bound
    rows = rows.join(F.broadcast(firsts), F.col("id") == F.col("first_id"), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))))
    dealt = rows.select("doc_id", "id", "text", F.xxhash64("text").alias("text_key"), signatures(F.col("text")).alias("spots"), F.explode(places).alias("place"))
    dealt = dealt.select("doc_id", "id", "text", "text_key", "spots", F.col("place.bucket").alias("bucket"), F.col("place.extra").alias("extra"))
    order = Window.partitionBy("bucket").orderBy("extra", "id", "text_key")
    led = dealt.select("doc_id", "text", "spots", "extra", F.lead("text").over(order).alias("next_text"), F.lead("spots").over(order).alias("next_spots"))
    return led.where(~F.col("extra")).drop("extra")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited forms, and how alike they are; null counts as empty.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    Repeated rows each get a row; a single row is its own next document; an empty table gives an empty result.
    """
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "spots", "next_spots")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "spots", "next_spots",
                       signatures(F.col("edited")).alias("edited_spots"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_chars", "edited_sha256", printed(F.col("spots")).alias("fingerprint"),
        printed(F.col("edited_spots")).alias("edited_fingerprint"), likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"))


def matches(queries: DataFrame, docs: DataFrame, tau: float = 0.8) -> DataFrame:
    """All pairs ``(query_id, doc_id, likeness)`` of likeness ``tau`` or more between ``queries`` and ``docs`` (doc_id, text).

    Equal sets are one class on both sides, so copies don't multiply the work; ``doc_id`` is the smallest of its class,
    ``query_id`` as well, and every other member of a class has the same matches. Texts without words match nothing.
    """
    def classes(frame: DataFrame, name: str) -> DataFrame:
        sets = frame.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("spots")).where(F.size("spots") > 0)
        return pin(sets.groupBy("spots").agg(F.min("doc_id").alias(f"{name}_id")).select(
            f"{name}_id", "spots", F.floor(F.log(F.size("spots").cast("double")) / F.lit(-math.log(tau)) + 1e-9).cast("int").alias("part")), name)

    asked, held = classes(queries, "query"), classes(docs, "doc")
    counts = held.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count(F.lit(1)).alias("n"))

    def rarest(frame: DataFrame, name: str) -> DataFrame:
        """The signatures of which a match must share one: the rarest L - ceil(tau * L) + 1."""
        spread = frame.select(f"{name}_id", "part", F.size("spots").alias("size"), F.explode("spots").alias("spot")).join(counts, "spot", "left")
        order = Window.partitionBy(f"{name}_id").orderBy(F.coalesce("n", F.lit(0)), "spot")
        spread = spread.withColumn("rank", F.row_number().over(order))
        return spread.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * tau - 1e-9) + 1).select(f"{name}_id", "part", "size", "spot")

    left = rarest(asked, "query").withColumn("part", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1))).withColumnRenamed("size", "asked_size")
    pairs = left.join(rarest(held, "doc"), ["part", "spot"]).where(F.least("size", "asked_size") >= tau * F.greatest("size", "asked_size") - 1e-9)
    pairs = pairs.select("query_id", "doc_id").distinct()
    sets = pairs.join(asked.select("query_id", F.col("spots").alias("a")), "query_id").join(held.select("doc_id", F.col("spots").alias("b")), "doc_id")
    return sets.select("query_id", "doc_id", likeness(F.col("a"), F.col("b")).alias("likeness")).where(F.col("likeness") >= tau - 1e-9)
