"""Conversation structure repair: the cheapest edits that make a conversation well-formed, by bidirectional Dijkstra over the edit lattice.

A conversation is well-formed if its role initials spell ``(s?(ua)+)?``. Node (i, t) of the lattice means that i rows are done and the
repaired roles so far end in state t: nothing yet, s, u or a. Edges keep a row (0), give it another role (2), delete it (3) or
insert an empty row (2); a truncated row that stays costs 1 more, and blank or duplicate rows can only be deleted. A forward heap
grows from (0, nothing) and a reverse heap from the legal ends. Once they meet, both go on until no crossing of equal cost can be missing;
of all cheapest paths the one whose audit (the edits' initials) is least in ASCII order wins.

Rows are sorted by conversation and turn into ranges, so even a conversation with a third of all rows is spread, and each
range is cut into pieces of at most ``PIECE_ROWS`` rows and about ``PIECE_BYTES`` bytes. A conversation that lies in one piece is repaired at once.
The pieces of others are solved for every pair of entry and exit state; a backward pass over these small tables (no texts) then picks each
piece's pair. Inserts belong to the row after them, so the tables join to the audit that the whole lattice would give. Duplicates across
pieces are found from digests alone.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.llm.common import bound_batches
from provenance_spark.session import ensure_checkpoint_dir, shuffle_partitions, workspace_path

PIECE_ROWS = 256
PIECE_BYTES = 1 << 16
#: Characters of role and text by which ranges are cut; rows that agree in them share a range.
CUT_CHARS = 32

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: States in the order of their numbers: nothing yet, after a system row, after a user row, after an assistant row.
STATES = "-sua"
#: The state that a row of role initial r leads to from each state.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What must still be inserted where the rows end in a state: its cost and audit.
ENDS = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

PIECE = T.StructType([
    T.StructField("piece", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("n_rows", T.LongType()),
    T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
    T.StructField("first_turn", T.LongType()), T.StructField("last_turn", T.LongType()), T.StructField("turns", T.LongType()),
    T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()), T.StructField("truncated", T.LongType()),
    T.StructField("illegal", T.LongType()), T.StructField("first_role", T.StringType()), T.StructField("last_role", T.StringType()),
    T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
ARROW = pa.schema([
    ("piece", pa.int64()), ("whole", pa.bool_()), ("n_rows", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("cost", pa.int64()),
    ("audit", pa.string())])


# ---- the lattice

Row = tuple[str, bool, int]  # role initial, must be deleted, cost of staying


def edges(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """Edits from a node: (next i, next state, cost, initial). No inserts after the last row: ENDS has them."""
    if i == len(rows):
        return
    role, gone, stay = rows[i]
    yield i + 1, state, DELETE, "D"
    if not gone:
        kept = NEXT.get((state, role))
        if kept is not None:
            yield i + 1, kept, stay, "K"
        for r in "ua":
            if r != role and (state, r) in NEXT:
                yield i + 1, NEXT[state, r], REROLE + stay, "R"
    for r in "ua":
        if (state, r) in NEXT:
            yield i, NEXT[state, r], INSERT, "I"


def back_edges(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """The same edges by their end: (i before, state before, cost, initial)."""
    befores = [(j, t) for j in (i, i - 1) if j >= 0 for t in range(len(STATES))]
    for j, t in befores:
        for to, end, cost, label in edges(rows, j, t):
            if to == i and end == state:
                yield j, t, cost, label


def cheapest(rows: list[Row], entry: int, exits: dict[int, tuple[int, str]]) -> tuple[int, str] | None:
    """Least (cost, audit) from state ``entry`` before the rows to one of ``exits`` after them, whose own cost and audit are added.

    Both heaps hold (cost, layer) in the order of their search, so a node's audit is final when it is popped: edges
    without cost lead to the next layer only.
    """
    n = len(rows)
    seen = ({(0, entry): (0, "")}, {(n, t): end for t, end in exits.items()})
    heaps = ([(0, 0, 0, entry)], sorted((c, 0, n, t) for t, (c, _) in exits.items()))
    done: tuple[set, set] = (set(), set())
    best: tuple[int, str] | None = None

    def meet(cost: int, first: str, label: str, last: str) -> None:
        nonlocal best
        if best is None or cost < best[0] or (cost == best[0] and first + label + last < best[1]):
            best = (cost, first + label + last)

    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = 0 if (heaps[0][0][0], len(done[0])) <= (heaps[1][0][0], len(done[1])) else 1
        cost, _, i, state = heapq.heappop(heaps[side])
        node = (i, state)
        if node in done[side]:
            continue
        done[side].add(node)
        audit = seen[side][node][1]
        if side == 0 and i == n and state in exits:
            meet(cost + exits[state][0], audit, "", exits[state][1])
        if node in done[1 - side]:
            far, rest = seen[1 - side][node]
            meet(cost + far, *((audit, "", rest) if side == 0 else (rest, "", audit)))
        for j, t, step, label in (edges if side == 0 else back_edges)(rows, i, state):
            there, reached = (j, t), (cost + step, audit + label if side == 0 else label + audit)
            if there in done[1 - side]:
                far, rest = seen[1 - side][there]
                meet(cost + step + far, *((audit, label, rest) if side == 0 else (rest, label, audit)))
            if there not in done[side] and (there not in seen[side] or reached < seen[side][there]):
                if there not in seen[side] or reached[0] < seen[side][there][0]:
                    heapq.heappush(heaps[side], (reached[0], j if side == 0 else n - j, j, t))
                seen[side][there] = reached
    return best


def apply(audit: str, entry: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of ``audit``."""
    out_roles, out_texts, i, state = [], [], 0, entry
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        r = roles[i][:1] if edit == "K" else "a" if state == 2 else "u"
        out_roles.append(roles[i] if edit == "K" else ROLES[r])
        out_texts.append("" if edit == "I" else texts[i])
        i, state = i + (edit != "I"), NEXT[state, r]
    return out_roles, out_texts


# ---- rows and pieces


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            dropped: str = "dropped") -> DataFrame:
    """``rows`` with the damage that crc32 of ``conv:turn`` picks, to test repairs on; lost rows stay, marked in ``dropped``.

    Remainders modulo 20: 0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks out, 3 repeats it, 4 makes it
    the user's. Nulls count as one space, in the key as in role and text; conversation and turn stay null.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col(text_col), blank), F.coalesce(F.col(role_col), blank)
    out = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias(dropped), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def _fault(role: str, text: str, seen: set) -> str:
    """b(lank), d(uplicate), t(runcated) or nothing; remembers role and text."""
    bare = text.rstrip(SPACE)
    if not bare.strip(SPACE):
        return "b"
    key = (role, text)
    if key in seen:
        return "d"
    seen.add(key)
    return "" if bare[-1] in ".!?" else "t"


def _rows(roles: list[str], faults: list[str]) -> list[Row]:
    return [(r[:1], f in ("b", "d"), TRUNCATED * (f == "t")) for r, f in zip(roles, faults, strict=True)]


class Piece:
    """Consecutive rows of one conversation."""

    def __init__(self, conv, piece: int):
        self.conv, self.piece, self.roles, self.texts, self.turns, self.size = conv, piece, [], [], [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.size += len(text) + len(role)

    def full(self) -> bool:
        return len(self.roles) >= PIECE_ROWS or self.size >= PIECE_BYTES

    def row(self, whole: bool) -> dict:
        """The piece's row; a whole conversation is repaired, the rows of another piece stay as they are."""
        turns = [t for t in self.turns if t is not None]
        out = {"piece": self.piece, "whole": whole, "n_rows": len(self.roles), "roles": self.roles, "texts": self.texts,
               "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "turns": len(set(turns)), "illegal": 0,
               "first_role": self.roles[0][:1] if self.roles else None, "last_role": self.roles[-1][:1] if self.roles else None}
        out["illegal"] = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(self.roles, self.roles[1:], strict=False))
        if whole:
            seen: set = set()
            faults = [_fault(r, t, seen) for r, t in zip(self.roles, self.texts, strict=True)]
            out |= _counts(faults)
            cost, audit = cheapest(_rows(self.roles, faults), 0, ENDS)
            out["roles"], out["texts"] = apply(audit, 0, self.roles, self.texts)
            out |= {"cost": cost, "audit": audit}
        return out


def _counts(faults: list[str]) -> dict:
    return {"blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t")}


def pieces(rows: DataFrame) -> DataFrame:
    """``conv_id`` and PIECE: sorted rows in bounded pieces, numbered in order; conversations of one piece already repaired."""
    kind = rows.schema["conv_id"].dataType
    cut = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, CUT_CHARS), F.substring("text", 1, CUT_CHARS)]
    held = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *cut).sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    arrow = pa.schema([pa.field("conv_id", _arrow_type(kind)), *ARROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        at: Piece | None = None
        split = True  # the range before may hold rows of the first conversation
        out: list[dict] = []
        size = 0
        for b in batches:
            for conv, turn, role, text, lost in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at is not None and (conv != at.conv or (at.full() and not lost)):
                    cut_here = conv == at.conv
                    out.append({"conv_id": at.conv, **at.row(not split and not cut_here)})
                    size += at.size
                    split, at = cut_here, None
                    if size >= 1 << 22 or len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, size = [], 0
                if at is None:
                    number += 1
                    at = Piece(conv, number)
                if not lost:
                    at.add(turn, role, text)
        if at is not None:
            out.append({"conv_id": at.conv, **at.row(False)})
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return held.select("conv_id", "turn", "role", "text", "lost").mapInArrow(run, T.StructType([T.StructField("conv_id", kind), *PIECE.fields]))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def _copies(split: DataFrame) -> DataFrame:
    """``(piece, again)``: the places in a piece of rows whose role and text stand in an earlier piece of the conversation."""
    each = split.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "m"))
    text = F.col("m.texts")
    digest = F.sha2(F.concat(F.length("m.roles").cast("string"), F.lit(":"), "m.roles", text).cast("binary"), 256)
    keyed = each.where(text.rlike(r"[^\x20\x09-\x0D]")).select("conv_id", "piece", "place", digest.alias("digest"))
    local = keyed.groupBy("conv_id", "digest", "piece").agg(F.min("place").alias("place"))  # later places of a piece are its own affair
    first = local.groupBy("conv_id", "digest").agg(F.min("piece").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = (local["conv_id"].eqNullSafe(first["conv_id"])) & (local["digest"] == first["digest"]) & (local["piece"] > first["first"])
    return local.join(first, same).groupBy("piece").agg(F.collect_list("place").alias("again"))  # at most PIECE_ROWS places


TABLE = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("cost", T.LongType()),
                      T.StructField("audit", T.StringType())])
TABLE_ARROW = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _solved(split: DataFrame) -> DataFrame:
    """The split pieces with their faults and, for every entry and exit state, the cheapest edits."""
    schema = T.StructType([*split.drop("again").schema.fields, T.StructField("table", T.ArrayType(TABLE))])
    names = [f.name for f in split.drop("again").schema.fields]
    kind = split.schema["conv_id"].dataType
    arrow = pa.schema([pa.field("conv_id", _arrow_type(kind)), *ARROW, ("table", TABLE_ARROW)])
    arrow = pa.schema([arrow.field(n) for n in [*names, "table"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                again, seen = set(row.pop("again") or ()), set()
                faults = [_fault(r, t, seen) for r, t in zip(row["roles"], row["texts"], strict=True)]
                faults = ["d" if i in again and f != "b" else f for i, f in enumerate(faults)]
                lattice = _rows(row["roles"], faults)
                cells = ((e, x, cheapest(lattice, e, {x: (0, "")})) for e in range(len(STATES)) for x in range(len(STATES)))
                out.append({**row, **_counts(faults),
                            "table": [{"entry": e, "exit": x, "cost": c[0], "audit": c[1]} for e, x, c in cells if c is not None]})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return split.select(*names, "again").mapInArrow(run, schema)


def _chained(tables: DataFrame) -> DataFrame:
    """``(piece, entry, last)``: the entry state of each piece on the cheapest way through its conversation, and whether it is the last piece.

    A conversation's tables come in descending order; of each piece four choices are held, a few bytes, never texts.
    """
    n = shuffle_partitions(tables.sparkSession)
    held = tables.select("conv_id", "piece", "table").repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, cost, way = object(), {}, []

        def walk() -> Iterator[pa.RecordBatch]:
            state, rows = 0, []
            for k, (piece, choice) in enumerate(reversed(way)):
                rows.append({"piece": piece, "entry": state, "exit": choice[state], "last": k == len(way) - 1})
                state = choice[state]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[i:i + 10_000], pa.schema([("piece", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_())]))

        for b in batches:
            for c, piece, table in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv:
                    yield from walk()
                    conv, cost, way = c, {t: e[0] for t, e in ENDS.items()}, []
                    tail = {t: e[1] for t, e in ENDS.items()}
                else:
                    tail = dict.fromkeys(ENDS, "")
                best: dict[int, tuple[int, str, int]] = {}
                for x in table:
                    if x["exit"] in cost:
                        found = (x["cost"] + cost[x["exit"]], x["audit"] + tail[x["exit"]], x["exit"])
                        best[x["entry"]] = min(best.get(x["entry"], found), found)
                cost = {e: f[0] for e, f in best.items()}
                way.append((piece, bytes(best[e][2] if e in best else 0 for e in range(len(STATES)))))
        yield from walk()

    return held.mapInArrow(run, "piece long, entry int, exit int, last boolean")


def repaired(rows: DataFrame, dropped: str = "dropped") -> DataFrame:
    """Conversations repaired: ``conv_id`` and PIECE, one row a piece, its ``roles`` and ``texts`` after the edits of ``audit``.

    ``rows`` has conv_id, turn, role, text and may have a mark of lost rows, which count for nothing but that their conversation has a row.
    Order: turn, nulls first; rows of equal turn by role and text. A null conv_id is a conversation; null or empty role: a row that can't be kept; null text:
    blank. Equal rows after the first are duplicates, in long conversations too. Roles count by their first letter, in this case only;
    other columns don't matter. A conversation without rows has one piece without any; an empty table has none.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    ensure_checkpoint_dir(spark)
    lost = F.col(dropped) if dropped in rows.columns else F.lit(False)
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                         F.coalesce("text", F.lit(" ")).alias("text"), lost.alias("lost"))
    path = workspace_path(spark, "pieces")
    pieces(filled).write.parquet(path)
    made = spark.read.parquet(path)
    split = made.where("NOT whole")
    solved_path = workspace_path(spark, "tables")
    _solved(split.join(_copies(split), "piece", "left")).write.parquet(solved_path)
    solved = spark.read.parquet(solved_path)
    chosen = solved.join(_chained(solved), "piece")
    return made.where("whole").unionByName(_edited(chosen))


def _edited(chosen: DataFrame) -> DataFrame:
    """Split pieces after the edits of their chosen way."""
    names = ["conv_id", *(f.name for f in PIECE.fields)]
    schema = T.StructType([chosen.schema["conv_id"], *PIECE.fields])
    arrow = pa.schema([pa.field("conv_id", _arrow_type(chosen.schema["conv_id"].dataType)), *ARROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                cell = next(x for x in row["table"] if (x["entry"], x["exit"]) == (row["entry"], row["exit"]))
                end = ENDS[row["exit"]] if row["last"] else (0, "")
                audit = cell["audit"] + end[1]
                roles, texts = apply(audit, row["entry"], row["roles"], row["texts"])
                out.append({n: row[n] for n in names} | {"cost": cell["cost"] + end[0], "audit": audit, "roles": roles, "texts": texts})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return chosen.mapInArrow(run, schema)


def messages(repaired: DataFrame) -> DataFrame:
    """``(conv_id, piece, place, role, text)``: a row for each message of the repaired conversations; order by piece and place."""
    each = repaired.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "m"))
    return each.select("conv_id", "piece", "place", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


def digest(repaired: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, illegal pairs, cost, audit and the SHA-256 of its repaired messages.

    A conversation's pieces come in order through one task, which holds one piece, a hash state and the audit (a letter an edit).
    """
    schema = T.StructType([repaired.schema["conv_id"], *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = pa.schema([pa.field("conv_id", _arrow_type(repaired.schema["conv_id"].dataType)),
                       *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                       ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict | None = None

        def close() -> dict:
            span = 0 if at["low"] is None else at["high"] - at["low"] + 1 - at["turns"]
            return {"conv_id": at["conv_id"], "gaps": span, **at["sums"], "audit": "".join(at["audit"]), "repaired_sha256": at["hash"].hexdigest()}

        for b in batches:
            out = []
            for p in b.to_pylist():
                if at is None or p["conv_id"] != at["conv_id"]:
                    if at is not None:
                        out.append(close())
                    at = {"conv_id": p["conv_id"], "low": None, "high": None, "turns": 0, "audit": [], "hash": hashlib.sha256(), "any": False,
                          "role": None, "sums": dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)}
                for n in at["sums"]:
                    at["sums"][n] += p[n] or 0
                if p["first_turn"] is not None:
                    at["turns"] += p["turns"] - (at["high"] == p["first_turn"])
                    at["low"] = p["first_turn"] if at["low"] is None else at["low"]
                    at["high"] = p["last_turn"]
                if p["n_rows"]:
                    if at["role"] is not None:
                        at["sums"]["illegal"] += at["role"] + p["first_role"] not in LEGAL
                    at["role"] = p["last_role"]
                at["audit"].append(p["audit"])
                lines = [f"{r}:{t}" for r, t in zip(p["roles"], p["texts"], strict=True)]
                if lines:
                    at["hash"].update((("\n" if at["any"] else "") + "\n".join(lines)).encode())
                    at["any"] = True
            yield pa.RecordBatch.from_pylist(out, arrow)
        if at is not None:
            yield pa.RecordBatch.from_pylist([close()], arrow)

    n = shuffle_partitions(repaired.sparkSession)
    split = repaired.where("NOT whole").repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece")
    return repaired.where("whole").mapInArrow(run, schema).union(split.mapInArrow(run, schema))

