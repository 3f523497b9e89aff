"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a fixed shuffled order, are cut into blocks of about ``block_chars`` characters. In the fluid
mixture all sources advance at once, each by its weight, and those that have run out leave their share to the
others. A block is released at the slot in which the fluid mixture begins it and due by the end of the slot in which it
ends it; earliest deadline first over these windows gives every slot to one block, and no source is ever a
whole block ahead of or behind the fluid mixture.

Weights are whole parts; a frame has one slot per part, so it begins and ends with every source exactly on target.
Frames are alike until a source runs out: each source changes the make-up of frames at most twice. One
template per make-up is scheduled, its size bounded by the sum of parts; all blocks look their slot up
by frame number and place in the frame. Documents never pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerscope.functions.ordering import prefix_totals
from ledgerscope.llm.shared import fresh, quoted, same
from ledgerscope.session import pin

BLOCK_CHARS = 1 << 16
PARTS = 1000


def _source_key(source: Column) -> Column:
    """A source as a join key that also names the null source."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def _sized(docs: DataFrame) -> DataFrame:
    """Ids, source keys, text hashes and lengths of all rows, written once: the texts are read a single time."""
    return pin(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _source_key(F.col("source")).alias("key"), F.xxhash64("text").alias("text_key"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size")), "sizes")


def tempered_parts(sizes: DataFrame, power: float = 0.7, parts: int = PARTS) -> DataFrame:
    """``(key, parts)`` of ``sizes(key, size)``: weights proportional to a power of a source's size, one part at least."""
    weights = sizes.groupBy("key").agg(F.pow(F.sum("size").cast("double"), F.lit(power)).alias("w"))
    total = weights.agg(F.sum("w").alias("total"))
    return weights.join(F.broadcast(total)).select(
        "key", F.greatest(F.lit(1), F.coalesce(F.round(F.lit(float(parts)) * F.col("w") / F.col("total")), F.lit(1))).cast("long").alias("parts"))


def _placed(sizes: DataFrame, seed: int) -> DataFrame:
    """Every row with the characters before it in its source's shuffled order."""
    rows = sizes.withColumn("draw", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    placed = prefix_totals(rows, F.shiftright("draw", 56), F.shiftright("draw", 48), ["draw", "doc_id", "text_key"], ["size"], ["key"])
    return pin(placed, "placed")


def _sources(placed: DataFrame, parts: DataFrame, block_chars: int) -> DataFrame:
    """One row per source: key, parts, number of blocks."""
    wanted = parts.groupBy("key").agg(F.max("parts").cast("long").alias("parts"))
    sizes = placed.groupBy("key").agg(F.sum("size").alias("chars"))
    return pin(sizes.join(wanted, "key", "left").select(
        "key", F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)).cast("long").alias("parts"),
        F.greatest(F.lit(1), F.ceil(F.col("chars") / block_chars)).cast("long").alias("blocks")), "sources")


def schedule(sources: DataFrame) -> DataFrame:
    """Templates of frames for ``sources(key, parts, blocks)``.

    ``(first_frame, key, place, release, slot, deadline, offset, length)``: in frames from ``first_frame`` to the next
    template's, block number ``place`` of the frame's blocks of a source has that slot; ``offset`` slots lie before
    ``first_frame`` and each of its frames has ``length`` slots.
    """
    one = sources.agg(F.array_sort(F.collect_list(F.struct("key", "parts", "blocks"))).alias("all"))
    full = lambda s: F.floor(s["blocks"] / s["parts"]).cast("long")
    starts = F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.transform("all", full), F.transform("all", lambda s: full(s) + 1)))
    frames = one.select("all", F.explode(starts).alias("first_frame"))
    frames = frames.select("first_frame", F.transform("all", lambda s: F.struct(
        s["key"].alias("key"), s["parts"].alias("parts"),
        F.greatest(F.lit(0), F.least(s["parts"], s["blocks"] - F.col("first_frame") * s["parts"])).cast("long").alias("n"),
        F.least(s["blocks"], F.col("first_frame") * s["parts"]).cast("long").alias("before"))).alias("all"))
    zero = F.lit(0).cast("long")
    frames = frames.select("*", F.aggregate("all", zero, lambda a, s: a + s["n"]).alias("length"),
                           F.aggregate("all", zero, lambda a, s: a + s["before"]).alias("offset")).where("length > 0")
    # each step is written: merged into one projection, every lookup would build the arrays anew
    frames = pin(frames.withColumn("all", F.filter("all", lambda s: s["n"] > 0)), "frames")

    def served(s: Column, i: Column) -> Column:
        """Fluid slots, times the source's parts, when its first i blocks are done; who has run out takes no more."""
        return F.aggregate("all", zero, lambda a, o: a + F.least(o["parts"] * i, o["n"] * s["parts"]))

    windows = frames.withColumn("all", F.transform("all", lambda s: F.struct(
        s["key"].alias("key"), s["n"].alias("n"),
        F.transform(F.sequence(zero, s["n"] - 1), lambda i: F.floor(served(s, i) / s["parts"])).alias("release"),
        F.transform(F.sequence(zero, s["n"] - 1), lambda i: F.ceil(served(s, i + 1) / s["parts"])).alias("deadline"))))
    windows = pin(windows.repartition("first_frame"), "windows")

    def step(state: Column, t: Column) -> Column:
        due = F.zip_with("all", state["done"], lambda s, k: F.when(
            (k < s["n"]) & (F.get(s["release"], k) <= t),
            F.struct(F.get(s["deadline"], k).alias("deadline"), s["key"].alias("key"))))

        def taken(c: Column) -> Column:
            done = F.zip_with("all", state["done"], lambda s, k: F.when(s["key"] == c["key"], k + 1).otherwise(k))
            return F.struct(done.alias("done"), F.concat(state["picks"], F.array(c["key"])).alias("picks"))

        return F.transform(F.array(F.array_min(due)), taken)[0]  # binds the choice, so that it is made once

    start = F.struct(F.transform("all", lambda s: F.lit(0)).alias("done"), F.array().cast("array<string>").alias("picks"))
    run = windows.select("first_frame", "length", "offset", "all",
                        F.aggregate(F.sequence(zero, F.col("length") - 1), start, step, lambda s: s["picks"]).alias("picks"))
    picked = run.select("first_frame", "length", "offset", "all", F.posexplode("picks").alias("slot", "key"))
    order = Window.partitionBy("first_frame", "key").orderBy("slot")
    own = F.filter("all", lambda s: s["key"] == F.col("key"))[0]
    picked = picked.select("first_frame", "length", "offset", "key", "slot", own.alias("own"), (F.row_number().over(order) - 1).alias("place"))
    return picked.select(
        "first_frame", "key", F.col("place").cast("long").alias("place"), F.get(F.col("own.release"), F.col("place")).alias("release"),
        F.col("slot").cast("long").alias("slot"), F.get(F.col("own.deadline"), F.col("place")).alias("deadline"), "offset", "length")


def block_slots(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Slots of ``blocks(key, block)``: adds ``parts, release, slot, deadline``, all counted from the mixture's start."""
    templates = pin(schedule(sources), "templates")
    firsts = templates.groupBy("key").agg(F.array_distinct(F.collect_list("first_frame")).alias("firsts"))
    known = blocks.join(sources.join(firsts, "key"), "key").withColumn("frame", F.floor(F.col("block") / F.col("parts")).cast("long"))
    known = known.select("key", "block", "parts", "frame", (F.col("block") % F.col("parts")).alias("place"),
                         F.array_max(F.filter("firsts", lambda q: q <= F.col("frame"))).alias("first_frame"))
    start = F.col("offset") + (F.col("frame") - F.col("first_frame")) * F.col("length")
    return known.join(templates, ["key", "first_frame", "place"]).select(
        "key", "block", "parts", *[(start + F.col(c)).alias(c) for c in ("release", "slot", "deadline")])


def slots(docs: DataFrame, parts: DataFrame | None = None, block_chars: int = BLOCK_CHARS, seed: int = 7) -> DataFrame:
    """Per row of ``docs(doc_id, text, source)``: ``doc_id, key, text_key, source, parts, block, release, slot, deadline``.

    ``parts(source, parts)`` are the target weights as whole numbers; a source that isn't listed has one part, and
    without the table ``tempered_parts`` are used. The mixture holds every row once; once a source has run out, the
    others share the slots by their parts. The null source is a source; null and empty texts have no
    characters and go with the block they fall in. Repeated rows get a row each. The sum of parts bounds the work of a
    template, so parts should be a few thousand in sum.
    """
    sizes = _sized(docs)
    placed = _placed(sizes, seed)
    wanted = tempered_parts(sizes) if parts is None else parts.select(_source_key(F.col("source")).alias("key"), "parts")
    sources = _sources(placed, wanted, block_chars)
    cut = placed.join(sources.select("key", "blocks"), "key").select(
        "doc_id", "key", "text_key",
        F.least(F.floor(F.col("before_size") / block_chars), F.col("blocks") - 1).cast("long").alias("block"))
    found = pin(block_slots(sources, cut.select("key", "block").distinct()), "slots")
    source = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30))
    return cut.join(found, ["key", "block"]).select(
        "doc_id", "key", "text_key", source.alias("source"), "parts", "block", "release", "slot", "deadline")


def mixed(docs: DataFrame, parts: DataFrame | None = None, block_chars: int = BLOCK_CHARS, seed: int = 7) -> DataFrame:
    """``docs`` with its slot in the mixture in an extra column ``mix_slot`` (or a fresh name); read it in that order."""
    names = [fresh(docs, n) for n in ("slot_key", "slot_id", "slot_hash", "mix_slot", "doc_key", "doc_hash")]
    key, id_, hash_, slot, doc_key, doc_hash = names
    found = slots(docs, parts, block_chars, seed).groupBy("key", "doc_id", "text_key").agg(F.min("slot").alias(slot)).select(
        F.col("key").alias(key), F.col("doc_id").alias(id_), F.col("text_key").alias(hash_), slot)
    tagged = docs.withColumns({doc_key: _source_key(F.col("source")), doc_hash: F.xxhash64("text")})
    joined = tagged.join(found, same(docs, [doc_key, "doc_id", doc_hash], [key, id_, hash_]))
    return joined.select(*[quoted(c) for c in docs.columns], slot)
