"""Conversation structure repair by a run-length min-plus dynamic program.

A sound conversation is an optional system row and then user/assistant exchanges. Every row is kept (0), given
the other speaker's role (1) or deleted (2, forced for blank rows and repeats); an empty row may be inserted anywhere (5), and
a truncated row that isn't deleted costs 5 more. A row is one of nine symbols, and a symbol is a min-plus transition over
four states. Equal consecutive symbols are one run, which cached binary powers of the transition advance in
logarithmically many steps; the choices are then unrolled row by row for the audit.

A conversation may hold a third of all rows. Light rows, with a digest in place of the text, are dealt by range of
(conversation, turn, digest), so that it is cut into pieces. A piece is summed up by its transition; the pieces of a conversation are
joined from the end, which gives the cost still to come after each, and then all pieces unroll their choices at once, for every state
they might be entered in. Only the last step reads a conversation's texts in order, one row at a time: what it writes is
a sequence (and SHA-256 has no other form).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import arrow_schema, same
from ledgerscope.session import pin

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: A row that has to go.
GONE = "x"
_FAR = 1 << 50
_SPACE = " \t\n\x0b\x0c\r"
_SPEAKER = {USER: "user", ASSISTANT: "assistant"}

Costs = tuple[int, int, int, int]

#: Cost from each state to a sound end once all rows are done.
END: Costs = (0, 2 * INSERT, INSERT, 0)


# ---- the program --------------------------------------------------------------------------------

def _other(state: int) -> int:
    """The state that an inserted or re-roled row leads to."""
    return ASSISTANT if state == USER else USER


def _kept(symbol: str, state: int) -> int | None:
    """The state after keeping a row of that symbol, if it may stand there."""
    if symbol[0] == "s":
        return SYSTEM if state == START else None
    if symbol[0] in "ua":
        to = USER if symbol[0] == "u" else ASSISTANT
        return to if to == _other(state) else None
    return None


def _closed(v: Costs) -> Costs:
    """Costs to come where rows may be inserted first."""
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, a


def _before(symbol: str, after: Costs) -> Costs:
    """Costs to come before a row, from those after it."""
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if symbol != GONE:
            extra = TRUNCATED * int(symbol[1])
            best = min(best, REROLE + extra + after[_other(state)])
            to = _kept(symbol, state)
            if to is not None:
                best = min(best, extra + after[to])
        out.append(min(best, _FAR))
    return _closed(tuple(out))


_UNITS = [tuple(0 if i == j else _FAR for i in range(4)) for j in range(4)]


def _through(columns: tuple[Costs, ...], v: Costs) -> Costs:
    """Min-plus product of a transition, given by its columns, and a vector."""
    return tuple(min(min(columns[j][i] + v[j] for j in range(4)), _FAR) for i in range(4))


@lru_cache(maxsize=None)
def _power(symbol: str, bit: int) -> tuple[Costs, ...]:
    """The transition of ``2**bit`` rows of one symbol."""
    if bit == 0:
        return tuple(_before(symbol, unit) for unit in _UNITS)
    half = _power(symbol, bit - 1)
    return tuple(_through(half, column) for column in half)


@lru_cache(maxsize=200_000)
def _advanced(symbol: str, length: int, shape: Costs) -> Costs:
    bit = 0
    while length:
        if length & 1:
            shape = _through(_power(symbol, bit), shape)
        length, bit = length >> 1, bit + 1
    return shape


def advance(symbol: str, length: int, after: Costs) -> Costs:
    """Costs to come before a run, from those after it."""
    least = min(after)
    shape = _advanced(symbol, length, tuple(min(c - least, _FAR) for c in after))
    return tuple(min(c + least, _FAR) for c in shape)


def _shape(v: Costs) -> Costs:
    least = min(v)
    return tuple(min(c - least, _FAR) for c in v)


@lru_cache(maxsize=200_000)
def _shape_before(symbol: str, shape: Costs) -> Costs:
    return _shape(_before(symbol, shape))


@lru_cache(maxsize=200_000)
def _chosen(symbol: str, state: int, shape: Costs) -> tuple[str, int]:
    """The ASCII-least cheapest letters for one row and the state after it; ``shape`` holds the costs to come after it."""
    here, letters = _before(symbol, shape), ""
    while True:
        if here[state] == DELETE + shape[state]:
            return letters + "D", state
        if here[state] == INSERT + here[_other(state)]:
            letters, state = letters + "I", _other(state)
            continue
        extra, to = TRUNCATED * int(symbol[1]), _kept(symbol, state)
        if to is not None and here[state] == extra + shape[to]:
            return letters + "K", to
        return letters + "R", _other(state)


def runs_of(symbols: list[str]) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for symbol in symbols:
        if out and out[-1][0] == symbol:
            out[-1] = (symbol, out[-1][1] + 1)
        else:
            out.append((symbol, 1))
    return out


def transition(runs: list[tuple[str, int]]) -> tuple[Costs, ...]:
    """The columns of the transition of a whole piece."""
    columns = []
    for v in _UNITS:
        for symbol, length in reversed(runs):
            v = advance(symbol, length, v)
        columns.append(v)
    return tuple(columns)


def unroll(runs: list[tuple[str, int]], after: Costs, entries: tuple[int, ...]) -> dict[int, tuple[list[str], int]]:
    """Per state of entry the letters of every row and the state in which the piece is left."""
    ends = [after]
    for symbol, length in reversed(runs):
        ends.append(advance(symbol, length, ends[-1]))
    ends = ends[-2::-1]
    found: dict[int, tuple[list[str], int]] = {q: ([], q) for q in entries}
    for (symbol, length), end in zip(runs, ends):
        shapes = [_shape(end)] * length
        if symbol != GONE:
            for i in range(length - 2, -1, -1):
                shapes[i] = _shape_before(symbol, shapes[i + 1])
        for q, (letters, state) in found.items():
            if symbol == GONE:  # a deletion is never dearer before an insertion than behind it
                letters += ["D"] * length
                continue
            for shape in shapes:
                letter, state = _chosen(symbol, state, shape)
                letters.append(letter)
            found[q] = (letters, state)
    return found


def closing(state: int) -> str:
    return "I" * (END[state] // INSERT)


# ---- damage -------------------------------------------------------------------------------------

def _spaced(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(convs: DataFrame) -> DataFrame:
    """``convs(conv_id, turn, role, text)`` with a fifth or so of its rows dropped, emptied, cut, repeated or given another role.

    What happens to a row follows from the CRC-32 of ``conv_id:turn``. Nulls read as one space; conv_id and turn stay null.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = _spaced(convs).withColumn("kind", F.crc32(name.cast("binary")) % 20).where("kind != 0")
    kind = F.col("kind")
    rows = rows.withColumn("text", F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


# ---- Spark steps --------------------------------------------------------------------------------

_KEY = ("conv_id", "turn", "digest")


def _keyed(convs: DataFrame) -> DataFrame:
    """Rows with a 128-bit digest of role and text; rows of one turn are ordered by it."""
    named = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return _spaced(convs).withColumn("digest", F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, 16))


def _ordered(rows: DataFrame) -> DataFrame:
    """Light rows, equal ones once with their number, in conversation order and cut into parts of even size."""
    stripped = F.trim(F.col("text"), F.lit(_SPACE))
    letter = F.substring("role", 1, 1)
    light = pin(rows.select(
        *_KEY, F.when(letter.isin("s", "u", "a"), letter).otherwise("o").alias("letter"), letter.alias("initial"), (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut")), "turns")
    # the first place of each text is a combined minimum, so a text that fills a conversation isn't one group of rows
    first = light.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))).alias("at"))
    first = first.select("conv_id", F.col("at.turn").alias("turn"), "digest", F.lit(None).cast("string").alias("letter"), F.lit(None).cast("string").alias("initial"),
                         F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(0).alias("n"), F.lit(True).alias("first"))
    merged = light.withColumn("n", F.lit(1)).withColumn("first", F.lit(False)).unionByName(first).groupBy(*_KEY).agg(
        F.max("letter").alias("letter"), F.max("initial").alias("initial"), F.max("blank").alias("blank"), F.max("cut").alias("cut"),
        F.sum("n").cast("long").alias("n"), F.max("first").alias("first"))
    ranged = pin(merged, "turn_counts").repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id().cast("long"))
    return pin(ranged, "ordered_turns")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal ``keys``."""
    held_key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != held_key:
                yield held_key, held
                held = []
            held_key = key
            held.append(row)
    if held:
        yield held_key, held


def _symbols(row: dict) -> Iterator[tuple[str, int]]:
    """The symbol of a light row and, where equal rows follow, that of their deletion."""
    live = row["first"] and not row["blank"]
    if live:
        yield row["letter"] + str(int(row["cut"])), 1
    if row["n"] > live:
        yield GONE, row["n"] - live


def _runs(rows: list[dict]) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for row in rows:
        for symbol, n in _symbols(row):
            if out and out[-1][0] == symbol:
                out[-1] = (symbol, out[-1][1] + n)
            else:
                out.append((symbol, n))
    return out


_LEGAL = {"su", "ua", "au"}
_PIECE = ("part long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
          "first_initial string, last_initial string, columns array<long>")


def _pieces(ordered: DataFrame) -> DataFrame:
    """One row per piece of a conversation: counts, ends and the transition."""
    kind = ordered.schema["conv_id"].dataType
    ddl = f"conv_id {kind.simpleString()}, {_PIECE}"

    def run(batches):
        schema = None
        for batch in _peek(batches):
            schema = schema or pa.schema([batch[0].schema.field("conv_id"), *arrow_schema(_PIECE)])
            out = [summed(key, rows) for key, rows in _groups(batch[1], ("conv_id", "part"))]
            yield from _paged(out, schema)

    def summed(key, rows):
        blank = sum(r["n"] for r in rows if r["blank"])
        live = sum(1 for r in rows if r["first"] and not r["blank"])
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        illegal = sum((r["n"] - 1) for r in rows) + sum((a["initial"] + b["initial"]) not in _LEGAL for a, b in zip(rows, rows[1:]))
        return {"conv_id": key[0], "part": key[1], "blank": blank, "duplicate": sum(r["n"] for r in rows) - blank - live,
                "truncated": sum(1 for r in rows if r["first"] and not r["blank"] and r["cut"]), "illegal": illegal, "turns": len(set(turns)),
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
                "first_initial": rows[0]["initial"], "last_initial": rows[-1]["initial"], "columns": [c for v in transition(_runs(rows)) for c in v]}

    return ordered.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "digest").mapInArrow(run, ddl)


def _peek(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[pa.RecordBatch]]]:
    """The first batch, for its schema, together with all batches; nothing for no batches."""
    for first in batches:
        def whole():
            yield first
            yield from batches
        yield first, whole()
        return


def _paged(rows, schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    page = []
    for row in rows:
        page.append(row)
        if len(page) == size:
            yield pa.RecordBatch.from_pylist(page, schema=schema)
            page = []
    if page:
        yield pa.RecordBatch.from_pylist(page, schema=schema)


_MERGED = ("part long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, begins boolean, ends boolean, "
           "v0 long, v1 long, v2 long, v3 long")


def _merged(pieces: DataFrame) -> DataFrame:
    """Per piece the costs to come after it; counts and cost of the conversation stand with its first piece."""
    ddl = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, {_MERGED}"

    def joined(batches):
        for (conv_id,), rows in _groups(batches, ("conv_id",)):
            v, after = END, []
            for row in reversed(rows):
                after.append(v)
                v = _through(tuple(tuple(row["columns"][4 * j:4 * j + 4]) for j in range(4)), v)
            after.reverse()
            turned = [r for r in rows if r["turns"]]
            shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
            gaps = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - sum(r["turns"] for r in turned) + shared if turned else 0
            illegal = sum((a["last_initial"] + b["first_initial"]) not in _LEGAL for a, b in zip(rows, rows[1:]))
            for i, (row, costs) in enumerate(zip(rows, after)):
                yield {"conv_id": conv_id, "part": row["part"], "begins": i == 0, "ends": i == len(rows) - 1, "gaps": gaps, "cost": v[START],
                       "illegal": illegal + sum(r["illegal"] for r in rows), **{c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")},
                       **{f"v{j}": costs[j] for j in range(4)}}

    def run(batches):
        for first, whole in _peek(batches):
            yield from _paged(joined(whole), pa.schema([first.schema.field("conv_id"), *arrow_schema(_MERGED)]))

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, ddl)


_EDITS = "turn long, digest binary, e0 string, e1 string, e2 string, e3 string, x0 int, x1 int, x2 int, x3 int"


def _decided(ordered: DataFrame, merged: DataFrame) -> DataFrame:
    """Per light row its letters for each state the piece may be entered in; a piece's last row also names the states it is left in."""
    ends = merged.select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), "begins", "ends", "v0", "v1", "v2", "v3")
    joined = ordered.join(ends, same(ordered, ["conv_id", "part"], ["of", "of_part"])).drop("of", "of_part")
    ddl = f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, {_EDITS}"

    def decided(batches):
        for (conv_id, _), rows in _groups(batches, ("conv_id", "part")):
            last = rows[-1]
            entries = (START,) if last["begins"] else (START, SYSTEM, USER, ASSISTANT)
            found = unroll(_runs(rows), tuple(last[f"v{j}"] for j in range(4)), entries)
            at = 0
            for row in rows:
                here = slice(at, at + row["n"])
                at += row["n"]
                out = {"conv_id": conv_id, "turn": row["turn"], "digest": row["digest"], **{f"e{q}": "".join(found[q][0][here]) for q in entries}}
                if row is last:
                    out |= {f"x{q}": found[q][1] for q in entries}
                    if last["ends"]:
                        out |= {f"e{q}": out[f"e{q}"] + closing(found[q][1]) for q in entries}
                yield out

    def run(batches):
        for first, whole in _peek(batches):
            yield from _paged(decided(whole), pa.schema([first.schema.field("conv_id"), *arrow_schema(_EDITS)]))

    return joined.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "digest").mapInArrow(run, ddl)


class _Writer:
    """Applies letters to the rows of one conversation as they come by."""

    def __init__(self, put) -> None:
        self.state, self.entry, self.open, self.audit, self.put = START, START, None, [], put

    def decide(self, row: dict) -> None:
        letters = row[f"e{self.entry}"]
        self.audit.append(letters)
        cut = max(letters.find("K"), letters.find("R"))
        if cut < 0:
            self._insert(letters)
        else:
            self._insert(letters[:cut])
            self.open = letters[cut:]
        if row["x0"] is not None:
            self.entry = row[f"x{self.entry}"]

    def _insert(self, letters: str) -> None:
        for _ in range(letters.count("I")):
            self.state = _other(self.state)
            self.put(_SPEAKER[self.state], "")

    def text(self, row: dict) -> None:
        if self.open is None:
            return  # deleted, or an equal row that has been written
        letters, self.open = self.open, None
        if letters[0] == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[row["role"][0]]
            self.put(row["role"], row["text"])
        else:
            self.state = _other(self.state)
            self.put(_SPEAKER[self.state], row["text"])
        self._insert(letters[1:])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _together(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Decisions and texts by conversation, each decision just before the rows it is for."""
    edits = [f.strip().split() for f in _EDITS.split(",")][2:]
    texts = rows.select(*_KEY, F.lit(1).alias("tag"), "role", "text", *[F.lit(None).cast(kind).alias(c) for c, kind in edits])
    marks = decided.select(*_KEY, F.lit(0).alias("tag"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                           *[c for c, _ in edits])
    return marks.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_KEY, "tag")


def _worked(convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _keyed(convs.withColumn("turn", F.col("turn").cast("long")))
    ordered = _ordered(rows)
    merged = pin(_merged(_pieces(ordered)), "pieces")
    return rows, merged, _decided(ordered, merged)


def repaired(convs: DataFrame) -> DataFrame:
    """The repaired rows of ``convs(conv_id, turn, role, text)``: ``conv_id, position, role, text``, positions from 0.

    Nulls in role and text read as one space, a null conv_id is a conversation of its own, null turns come first. Rows of one
    turn are ordered by a digest of role and text; of equal rows the first may stay. A role that doesn't start with s, u or a (an
    empty one too) is re-roled or deleted. An empty table gives an empty result.
    """
    rows, _, decided = _worked(convs)
    both = _together(rows, decided)
    ddl = f"conv_id {both.schema['conv_id'].dataType.simpleString()}, position long, role string, text string"

    def run(batches):
        for first, whole in _peek(batches):
            schema = pa.schema([first.schema.field("conv_id"), *arrow_schema("position long, role string, text string")])
            yield from _paged(written(whole), schema, 500)

    def written(batches):
        writer, at, count, out = None, None, 0, []
        for row in _rows_of(batches):
            if writer is None or row["conv_id"] != at:
                at, count, out = row["conv_id"], 0, []
                writer = _Writer(lambda role, text, out=out: out.append((role, text)))
            (writer.text if row["tag"] else writer.decide)(row)
            for role, text in out:
                yield {"conv_id": at, "position": count, "role": role, "text": text}
                count += 1
            out.clear()

    return both.mapInArrow(run, ddl)


def _digests(both: DataFrame) -> DataFrame:
    ddl = f"conv_id {both.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string"

    def run(batches):
        for first, whole in _peek(batches):
            yield from _paged(hashed(whole), pa.schema([first.schema.field("conv_id"), *arrow_schema("audit string, repaired_sha256 string")]))

    def hashed(batches):
        writer = found = at = None
        for row in _rows_of(batches):
            if writer is None or row["conv_id"] != at:
                if writer is not None:
                    yield finished(at, writer, found)
                at, found = row["conv_id"], {"sha": hashlib.sha256(), "some": False}
                writer = _Writer(lambda role, text, found=found: add(found, role, text))
            (writer.text if row["tag"] else writer.decide)(row)
        if writer is not None:
            yield finished(at, writer, found)

    def add(found, role, text):
        found["sha"].update(("\n" * found["some"] + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        found["some"] = True

    def finished(conv_id, writer, found):
        return {"conv_id": conv_id, "audit": "".join(writer.audit), "repaired_sha256": found["sha"].hexdigest()}

    return both.mapInArrow(run, ddl)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(convs: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: ``conv_id``, its faults and their cost, ``audit`` (letters of the edits) and the SHA-256 of what ``repaired`` gives.

    ``all_ids`` may name more conversations than have rows; those get zeros, no letters and the hash of nothing. Other cases as in
    ``repaired``. A turn's gaps count missing whole numbers between the least and the largest turn.
    """
    rows, merged, decided = _worked(convs)
    digests = _digests(_together(rows, decided)).withColumnRenamed("conv_id", "of")
    totals = merged.where("begins").select(F.col("conv_id").alias("sum_of"), *COUNTS)
    ids = (all_ids if all_ids is not None else convs).select("conv_id").distinct()
    joined = ids.join(totals, ids["conv_id"].eqNullSafe(totals["sum_of"]), "left").join(digests, F.col("conv_id").eqNullSafe(digests["of"]), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
