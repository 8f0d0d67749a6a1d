"""Conversation repair: the cheapest edits that let roles take turns, by a parallel Viterbi pass.

Rows of all conversations are put in order by ranges, so one conversation may lie in many
partitions, and cut into chunks of so many rows. Each row is a letter: what its role
begins with, and whether it must go or is truncated.

Backward costs (what is still to pay from each of four states) run through the chunks of a
conversation in parallel: each starts from speculative vectors, one for each state, until
these differ only by constants; what lies before then no longer depends on how the costs
began. Chunks in which they still differ are run on into the chunks behind them, twice as far
in each fix-up pass, until they agree or the conversation ends. The stitched vectors then
drive the trace from the front, in which the least letter of an equally cheap edit wins;
states at chunk borders are settled in the same way.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import Batches, each_batch, parts, stored

# Rows of a chunk, and of a partition of the ordered rows.
CHUNK_ROWS = 4_096
PART_ROWS = 100_000
# Costs of the edits, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States: nothing written, last written system, user, assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
# Whose turn it is in each state, and the state once that role has spoken.
TURN = (USER, USER, ASSISTANT, USER)
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LETTER = {USER: "u", ASSISTANT: "a"}
FAR = 1 << 40
# Costs that rows leave behind are at most so far apart; speculative ones start so far apart.
SPREAD = 16
# Rows between two looks at whether speculative vectors agree.
LOOK = 64
_BLANK = r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: rows as their hash damages them; dropped ones are gone.

    Null roles and texts read as one space, and so do null ids and turns in the hash.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(h == 4, "user").otherwise(spaced("role"))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), h.alias("h"))
    return rows.where("h != 0").select("conv_id", "turn", "role", "text", F.when(F.col("h") == 3, 2).otherwise(1).alias("times"))


def _digest(*columns: str) -> Column:
    """Hash of columns, nulls apart from any value, parted by their lengths."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(part(c) for c in columns)), 256))


def in_order(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """All rows (conv_id, turn, role, text, times) in order, stored, with their place ``at``.

    By conv_id and turn, nulls first, then by role and text; where so many rows agree in all
    but what follows the first 64 characters that ranges part them, by their hash before
    the rest. ``times`` copies follow each other, with an empty text from the second on; equal
    rows are first counted, so that however many there are they are dealt over many ranges.
    ``at`` counts upwards without gaps.
    """
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    each = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"), _digest("conv_id", "role", "text").alias("digest"))
    each = each.withColumn("lead", F.left("text", F.lit(64))).withColumn("who", F.left("role", F.lit(64)))
    order = ["conv_id", "turn", "who", "lead", "digest", "nth"]
    text = F.when(F.col("nth") == 1, F.col("text")).otherwise("")
    # Dealing needs only columns of bounded length: their samples come to the driver.
    size = parts(rows.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0], part_rows)
    solid = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = F.when(~F.col("text").rlike(_BLANK), "b").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")
    sorted_rows = each.withColumn("fault", fault).repartitionByRange(size, *order)
    sorted_rows = sorted_rows.sortWithinPartitions("conv_id", "turn", "role", "text", "nth")
    made = stored(sorted_rows.select("conv_id", "turn", "role", text.alias("text"), "digest", "nth", "fault", F.monotonically_increasing_id().alias("id")))
    part = F.shiftright("id", 33)
    sizes = sorted((r.part, r.n) for r in made.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total - (p << 33)))
        total += n
    # One row for each partition.
    moved = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part bigint, offset bigint"))
    return made.join(moved, part == F.col("part")).withColumn("at", F.col("id") + F.col("offset")).drop("id", "part", "offset")


def chunks(ordered: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, first, last, letters and counts of each chunk, a run of a conversation's rows.

    ``letters`` has two characters for each row: the state its role leads to (- for none),
    then b blank, d duplicate, t truncated or -.
    """
    slim = ordered.select("conv_id", "turn", "at", "role", "fault", "digest")
    # Only rows that have earlier likes need to know the first of them.
    firsts = slim.groupBy("digest").agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = slim.join(firsts, "digest", "left")
    initial = F.when(F.col("role").rlike("^[sua]"), F.left("role", F.lit(1))).otherwise("-")
    fault = F.when(F.col("fault") == "b", "b").when(F.col("at") > F.col("earliest"), "d").otherwise(F.col("fault"))
    row = F.struct("at", F.concat(initial, fault).alias("letter"), "turn")
    # At most chunk_rows rows in each.
    made = marked.groupBy("conv_id", F.expr(f"at div {int(chunk_rows)}").alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    turns = F.array_compact(F.array_distinct("rows.turn"))
    return made.select(
        "conv_id", F.get("rows.at", F.lit(0)).alias("first"), F.element_at("rows.at", -1).alias("last"),
        F.array_join("rows.letter", "").alias("letters"), F.size(turns).cast("bigint").alias("turns"),
        F.array_min(turns).alias("least"), F.array_max(turns).alias("most"),
        F.get("rows.turn", F.lit(0)).alias("turn_first"), F.element_at("rows.turn", -1).alias("turn_last"),
    )


Vector = tuple[int, ...]


def _closed(v: Vector) -> Vector:
    """Costs with inserts allowed before the next row; two are enough to reach every state."""
    for _ in range(2):
        v = tuple(min(c, INSERT + v[TURN[q]]) for q, c in enumerate(v))
    return v


# At the end a conversation may be empty or have the assistant's turn behind it.
CLOSED = _closed((0, FAR, FAR, 0))


def _keeps(letter: str, q: int) -> int | None:
    """The state after a row is kept as it is, None where it can't be."""
    to = _STATE.get(letter[0])
    return to if letter[1] not in "bd" and to is not None and (to == TURN[q] or (q, to) == (EMPTY, SYSTEM)) else None


@lru_cache(maxsize=100_000)
def before(letter: str, v: Vector) -> Vector:
    """Costs before a row, from those after it."""
    if letter[1] in "bd":
        return _closed(tuple(DELETE + c for c in v))
    extra = TRUNCATED if letter[1] == "t" else 0
    costs = []
    for q in range(4):
        to = _keeps(letter, q)
        costs.append(min(DELETE + v[q], REROLE + extra + v[TURN[q]], FAR if to is None else extra + v[to]))
    return _closed(tuple(costs))


@lru_cache(maxsize=100_000)
def step(letter: str, v: Vector) -> tuple[Vector, int]:
    """The same less the least of them, and that; costs without end stay so."""
    costs = before(letter, v)
    least = min(costs)
    return tuple(min(c - least, FAR) for c in costs), least


@lru_cache(maxsize=100_000)
def act(letter: str, v: Vector, q: int) -> tuple[str, str, int, int]:
    """The cheapest edits for a row in state q, the least in ASCII: letters, what each writes, cost, next state."""
    here = before(letter, v)
    extra = TRUNCATED if letter[1] == "t" else 0
    edits, writes, cost = "", "", 0
    while True:
        turn, to = TURN[q], _keeps(letter, q)
        if here[q] == DELETE + v[q]:
            return edits + "D", writes + "-", cost + DELETE, q
        if here[q] == INSERT + here[turn]:
            edits, writes, cost, q = edits + "I", writes + _LETTER[turn], cost + INSERT, turn
        elif to is not None and here[q] == extra + v[to]:
            return edits + "K", writes + "k", cost + extra, to
        else:
            return edits + "R", writes + _LETTER[turn], cost + REROLE + extra, turn


def _split(letters: str) -> list[str]:
    return [letters[i : i + 2] for i in range(0, len(letters), 2)]


def run_back(rows: list[str], v: Vector) -> list[Vector]:
    """Costs before each row and after the last, each less its least."""
    found = [v]
    for letter in reversed(rows):
        found.append(step(letter, found[-1])[0])
    return found[::-1]


def product(m: np.ndarray, then: np.ndarray) -> np.ndarray:
    """A chunk's costs run on through those of the chunks behind it."""
    return np.minimum((m[:, :, None] + then[None, :, :]).min(axis=1), FAR)


_SPECULATIVE = np.where(np.eye(4, dtype=bool), 0, SPREAD)


def agreed(m: np.ndarray) -> Vector | None:
    """The costs before a chunk, if all that may lie behind it gives the same but for a constant."""
    tried = product(m, _SPECULATIVE)
    if (np.ptp(tried - tried[:, :1], axis=0) == 0).all():
        return tuple(int(c) for c in tried[:, 0] - tried[:, 0].min())
    return None


def speculate(letters: str) -> tuple[np.ndarray, Vector | None]:
    """Costs before a chunk (rows) for each state that may follow it (columns); or where these
    agree on the way, the one vector from there on."""
    rows = _split(letters)
    vectors = [_closed(tuple(0 if p == q else FAR for p in range(4))) for q in range(4)]
    paid = [0, 0, 0, 0]
    for i in range(len(rows) - 1, -1, -1):
        for q in range(4):
            vectors[q], more = step(rows[i], vectors[q])
            paid[q] += more
        if i % LOOK == 0:
            m = np.minimum(np.array(vectors).T + np.array(paid), FAR)
            one = agreed(m)
            if one is not None:
                return m, run_back(rows[:i], one)[0]
    return m, None


def trace(letters: str, after: Vector, q: int, closes: bool) -> tuple[str, str, int, int]:
    """The cheapest edits of a chunk from state q, given costs after it: letters, what each writes, cost, last state.

    Writes: k the row as it is, u or a a row of that role, - none.
    """
    rows = _split(letters)
    costs = run_back(rows, after)
    edits, writes, cost = [], [], 0
    for letter, v in zip(rows, costs[1:]):
        e, w, c, q = act(letter, v, q)
        edits.append(e)
        writes.append(w)
        cost += c
    while closes and q not in (EMPTY, ASSISTANT):
        q = TURN[q]
        edits.append("I")
        writes.append(_LETTER[q])
        cost += INSERT
    return "".join(edits), "".join(writes), cost, q


def _linked(pieces: DataFrame) -> DataFrame:
    """Chunks with the place of the one behind them (``next``), its first letter and turn, and whether one lies before."""
    right = pieces.select(F.col("conv_id").alias("c"), F.col("first").alias("next"), F.left("letters", F.lit(1)).alias("next_letter"), F.col("turn_first").alias("next_turn"))
    made = pieces.join(right, (F.col("last") + 1 == F.col("next")) & F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    fronts = pieces.select(F.col("conv_id").alias("c"), (F.col("last") + 1).alias("f"))
    made = made.join(fronts, (F.col("first") == F.col("f")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return made.withColumn("fore", F.col("f").isNotNull()).drop("c", "f")


def _vectors(many: DataFrame) -> DataFrame:
    """first, vector: costs before each chunk of conversations of several chunks."""
    schema = "first bigint, next bigint, m array<bigint>, vector array<bigint>"
    names = ["first", "next", "m", "vector"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def begin(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for first, behind, letters in zip(*(c.to_pylist() for c in batch.columns)):
            m, one = speculate(letters)
            if one is None and behind is None:
                one = tuple(product(m, np.array(CLOSED)[:, None])[:, 0].tolist())
            made.append((first, behind, m.ravel().tolist(), one))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), kinds)], names=names)

    def fix(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for first, behind, m, one, then, known, further in zip(*(c.to_pylist() for c in batch.columns)):
            if one is None:
                m = np.array(m).reshape(4, 4)
                if known is not None:
                    one = tuple(product(m, np.array(known)[:, None])[:, 0].tolist())
                else:
                    # Run on through all that the chunk behind has seen, so reach doubles.
                    m, behind = product(m, np.array(then).reshape(4, 4)), further
                    one = agreed(m)
                m = m.ravel().tolist()
            made.append((first, behind, m, one))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), kinds)], names=names)

    state = stored(many.select("first", "next", "letters").mapInArrow(each_batch(begin), schema))
    while not state.where("vector IS NULL").isEmpty():
        back = state.select(F.col("first").alias("b"), F.col("m").alias("then"), F.col("vector").alias("known"), F.col("next").alias("further"))
        run_on = state.join(back, F.when(F.col("vector").isNull(), F.col("next")) == F.col("b"), "left").drop("b")
        state = stored(run_on.mapInArrow(each_batch(fix), schema))
    return state.select("first", "vector")


def _states(many: DataFrame) -> DataFrame:
    """last, out: the state after each chunk, given ``after``, the costs behind it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for letters, after, closes in zip(*(c.to_pylist() for c in batch.columns[3:])):
            made.append([trace(letters, tuple(after), q, closes)[3] for q in range(4)])
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.int32()))], names=["last", "before", "fore", "to"])

    own = many.select("last", (F.col("first") - 1).alias("before"), "fore", "letters", "after", F.col("next").isNull().alias("closes"))
    to = F.col("to")
    known = F.when(~F.col("fore"), F.get(to, F.lit(EMPTY))).when(F.array_min(to) == F.array_max(to), F.array_min(to))
    made = own.mapInArrow(each_batch(run), "last bigint, before bigint, fore boolean, to array<int>")
    state = stored(made.select("last", "before", "to", known.alias("out")))
    while not state.where("out IS NULL").isEmpty():
        front = state.select(F.col("last").alias("l"), F.col("to").alias("from"), F.col("out").alias("known"), F.col("before").alias("further"))
        on = state.join(front, F.when(F.col("out").isNull(), F.col("before")) == F.col("l"), "left")
        through = F.when(F.col("l").isNotNull(), F.transform("from", lambda q: F.get(to, q))).otherwise(to)
        settled = F.coalesce("out", F.get(to, F.col("known")), F.when(F.array_min(through) == F.array_max(through), F.array_min(through)))
        state = stored(on.select("last", F.coalesce("further", "before").alias("before"), through.alias("to"), settled.alias("out")))
    return state.select("last", "out")


def repair_chunks(pieces: DataFrame) -> DataFrame:
    """Each of ``chunks`` with its cheapest edits: audit, places and what is written there, cost, illegal, beside its counts."""
    pieces = stored(_linked(pieces))
    closed = F.array(*(F.lit(c) for c in CLOSED)).cast("array<bigint>")
    # Most conversations are one chunk: their costs and states need no other.
    single = F.col("next").isNull() & ~F.col("fore")
    many = pieces.where(~single)
    vectors = _vectors(many).select(F.col("first").alias("v"), "vector")
    many = stored(many.join(vectors, F.col("next") == F.col("v"), "left").withColumn("after", F.coalesce("vector", closed)).drop("v", "vector"))
    out = _states(many).select((F.col("last") + 1).alias("o"), "out")
    begun = many.join(out, (F.col("first") == F.col("o")) & F.col("fore"), "left").withColumn("state", F.coalesce("out", F.lit(EMPTY))).drop("o", "out")
    whole = pieces.where(single).withColumn("after", closed).withColumn("state", F.lit(EMPTY))
    every = whole.unionByName(begun)
    passed = [c for c in every.columns if c not in ("letters", "after", "state", "next_letter")]
    types = dict(every.dtypes)
    new_columns = [
        ("letters", "string"), ("audit", "string"), ("places", "array<bigint>"), ("kept", "array<string>"),
        ("wrote", "array<string>"), ("cost", "bigint"), ("illegal", "bigint"),
    ]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(passed)
        behind, firsts = (batch.column(passed.index(c)).to_pylist() for c in ("next", "first"))
        letters, after, states, follow = (c.to_pylist() for c in batch.columns[n:])
        made = []
        for rows, v, q, last, more, first in zip(letters, after, states, behind, follow, firsts):
            audit, writes, cost, _ = trace(rows, tuple(v), q, last is None)
            roles = rows[::2] + (more or "")
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
            # Where each edit but deletions stands: an insert at the row it comes before.
            at, places = first, []
            for edit in audit:
                if edit != "D":
                    places.append(at)
                at += edit != "I"
            kept = [e for e in audit if e != "D"]
            made.append((rows, audit, places, kept, [w for w in writes if w != "-"], cost, illegal))
        kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64())
        new = [pa.array(list(c), k) for c, k in zip(zip(*made), kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=[*passed, *(n for n, _ in new_columns)])

    schema = ", ".join(f"`{c}` {types[c]}" for c in passed) + "".join(f", {n} {t}" for n, t in new_columns)
    return every.select(*passed, "letters", "after", "state", "next_letter").mapInArrow(each_batch(run), schema)


def repaired_rows(ordered: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv_id, at, seq, edit, turn, role, text: the repaired conversations, in the order of at and seq.

    Inserted rows have no turn and an empty text, and stand before the row they come before.
    """
    edits = repaired.select("conv_id", F.posexplode(F.arrays_zip("places", "kept", "wrote")).alias("seq", "e"))
    edits = edits.select("conv_id", F.col("e.places").alias("at"), "seq", F.col("e.kept").alias("edit"), F.col("e.wrote").alias("wrote"))
    name = F.when(F.col("wrote") == "u", "user").when(F.col("wrote") == "a", "assistant")
    added = edits.where("edit = 'I'").select(
        "conv_id", "at", "seq", "edit", F.lit(None).cast("bigint").alias("turn"), name.alias("role"), F.lit("").alias("text")
    )
    rows = ordered.select(F.col("at").alias("place"), "turn", "role", "text")
    stay = edits.where("edit != 'I'").join(rows, F.col("at") == F.col("place"))
    return stay.select("conv_id", "at", "seq", "edit", "turn", F.coalesce(name, "role").alias("role"), "text").unionByName(added)


def conversation_hashes(rows: DataFrame) -> DataFrame:
    """conv_id, sha256 of ``role:text`` of its ``repaired_rows``, joined by line breaks.

    SHA-256 reads a conversation from front to back, so one task reads each; rows pass one by
    one and none is kept.
    """

    def run(batches: Batches) -> Batches:
        current, digest = None, None
        done: list = []
        for batch in batches:
            for conv, role, text in zip(*batch.columns):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append((current.as_py(), digest.hexdigest()))
                    current, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role.as_py()}:{text.as_py()}".encode())
            if len(done) > 1_000:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], batch.schema.field(0).type), pa.array([h for _, h in done], pa.string())], names=["conv_id", "sha256"])
                done = []
        if digest is not None:
            done.append((current.as_py(), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], current.type), pa.array([h for _, h in done], pa.string())], names=["conv_id", "sha256"])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "seq").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, sha256 string")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """The repaired rows, and the chunks with their edits and counts, of rows (conv_id, turn, role, text, times)."""
    ordered = in_order(rows, part_rows)
    repaired = stored(repair_chunks(stored(chunks(ordered, chunk_rows))))
    return repaired_rows(ordered, repaired), repaired


def repair_report(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 after damage.

    One row for each conv_id of ``conversations`` (conv_id, turn, role, text), null among
    them; other columns are not read. Null roles and texts read as one space; null turns come
    first and don't count for gaps. Equal turns go by role and text, repeated rows follow
    each other. Roles other than those that begin with s, u or a are always illegal.
    A conversation without rows has zeros, no audit and the hash of nothing. An empty table
    gives no rows. The audit is one string, a letter for each edit.
    """
    rows, repaired = repair(damaged(conversations), chunk_rows, part_rows)
    count = lambda letter: F.sum(F.regexp_count("letters", F.lit(letter)))
    # A turn that goes on in the next chunk was counted in both.
    touch = F.when(F.col("next_turn") == F.col("turn_last"), 1).otherwise(0)
    gaps = F.coalesce(F.max("most") - F.min("least") + 1 - F.sum(F.col("turns") - touch), F.lit(0))
    audits = F.sort_array(F.collect_list(F.struct("first", "audit")))
    counted = repaired.groupBy("conv_id").agg(
        gaps.alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(audits["audit"], "").alias("audit"),
    )
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = F.lit(None)
    all_ids = conversations.select("conv_id").distinct().select("conv_id", *(none.cast("bigint").alias(c) for c in numbers), none.cast("string").alias("audit"), none.cast("string").alias("sha256"))
    hashes = conversation_hashes(rows).select("conv_id", *(none.cast("bigint").alias(c) for c in numbers), none.cast("string").alias("audit"), "sha256")
    found = counted.select("conv_id", *(F.col(c).cast("bigint").alias(c) for c in numbers), "audit", none.cast("string").alias("sha256"))
    every = all_ids.unionByName(found).unionByName(hashes).groupBy("conv_id")
    return every.agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
