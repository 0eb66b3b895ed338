"""Repair of conversation structure by Four-Russians block tables.

A conversation is a string of row symbols (role initial, fault) and a repaired one has the role initials
``(s?(ua)+)?``, an automaton of four states. The cheapest costs from each state to the end form a vector that,
less its least entry, takes few values: tables hold, for every such vector and every block of :data:`BLOCK`
symbols, the vector in front of the block and what it adds. A conversation is processed from its end by one
look-up a block; then its blocks are expanded against that direction, from the front, where costs to the end
are known for every step, so that of equally cheap edits the ASCII-least audit is followed letter by letter.

Rows are dealt by ranges of (conversation, turn). A conversation inside one range is done there. One that
meets a range's border, or is longer than :data:`FRAGMENT` rows, is cut into fragments: each gives its costs
between all pairs of states, a short chain a conversation joins those, and the fragments are traced in
parallel. Only the digest of a conversation goes through one task: SHA-256 is sequential. It is streamed there.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialize

START, SYSTEM, USER, ANSWER = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: A kept role's initial leads from a state to the next; the states that an inserted or renamed row leads to.
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ANSWER, (ANSWER, 1): USER}
TURN = (USER, USER, ANSWER, USER)
ROLE = {USER: "user", ANSWER: "assistant"}
#: Symbols: initial (s, u, a, other), 4 more if truncated; a row that must go. Stored codes tell why, or that it was dropped.
GO, BLANK, AGAIN, GONE = 8, 8, 9, 10
SYMBOLS = 9
#: Symbols in a block of the tables, and rows in a fragment of a long conversation.
BLOCK, FRAGMENT = 4, 4096
NEVER = 1 << 20
WHITE = " \t\n\x0b\x0c\r"


def _closed(costs: list[int]) -> tuple[int, ...]:
    """``costs`` from each state with inserted rows in front."""
    costs = list(costs)
    for _ in range(2):
        costs = [min(c, INSERT + costs[TURN[q]]) for q, c in enumerate(costs)]
    return tuple(min(c, NEVER) for c in costs)


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs from each state in front of a row, from those behind it."""
    costs = [DELETE + c for c in after]
    if symbol != GO:
        kind, extra = symbol % 4, TRUNCATED * (symbol // 4)
        for q in range(4):
            costs[q] = min(costs[q], REROLE + extra + after[TURN[q]])
            if (q, kind) in KEEP:
                costs[q] = min(costs[q], extra + after[KEEP[q, kind]])
    return _closed(costs)


class Tables:
    """``vectors``, and for each vector and block ``next`` (the vector in front) and ``add``.

    ``choice[v, symbol, q]`` is the ASCII-least cheapest edit of a row in state q with vector v behind it, and
    ``then`` the state that it leads to. Vectors 0 to 3 reach that state only; ``end`` is a conversation's end.
    """

    def __init__(self) -> None:
        known: dict[tuple[int, ...], int] = {}

        def number(v: tuple[int, ...]) -> tuple[int, int]:
            low = min(v)
            v = tuple(c if c >= NEVER else c - low for c in v)
            return known.setdefault(v, len(known)), low

        for q in range(4):
            number(_closed([0 if p == q else NEVER for p in range(4)]))
        self.end, _ = number(_closed([0, NEVER, NEVER, 0]))
        rows, done = [], 0
        while done < len(known):
            v = list(known)[done]
            rows.append([number(_before(v, x)) for x in range(SYMBOLS)])
            done += 1
        self.vectors = np.array(list(known), np.int64)
        one = np.array(rows, np.int64)
        self.steps = {1: (one[..., 0], one[..., 1])}
        for size in range(2, BLOCK + 1):  # the last symbols of a block are met first
            (n, a), (nx, ad), count = self.steps[1], self.steps[size - 1], SYMBOLS ** (size - 1)
            lead, rest = np.divmod(np.arange(SYMBOLS * count), count)
            mid = nx[:, rest]
            self.steps[size] = (n[mid, lead], ad[:, rest] + a[mid, lead])
        shape = (len(known), SYMBOLS, 4)
        self.choice, self.then = np.zeros(shape, np.int8), np.zeros(shape, np.int8)
        for i, after in enumerate(known):
            for x in range(SYMBOLS):
                before = _before(after, x)
                for q in range(4):
                    keep = KEEP.get((q, x % 4)) if x != GO else None
                    extra = TRUNCATED * (x // 4)
                    options = [("D", DELETE + after[q], q), ("I", INSERT + before[TURN[q]], TURN[q])]
                    options += [("K", extra + after[keep], keep)] if keep is not None else []
                    options += [("R", REROLE + extra + after[TURN[q]], TURN[q])] if x != GO else []
                    letter, then = next(((s, to) for s, cost, to in options if cost == before[q] or before[q] >= NEVER))
                    self.choice[i, x, q], self.then[i, x, q] = ord(letter), then


@functools.cache
def tables() -> Tables:
    return Tables()


def sweep(symbols: np.ndarray, vector: int) -> tuple[list[int], int]:
    """Vectors at the borders of ``symbols``' blocks, from the front, and the cost added; ``vector`` lies behind.

    The first block holds what is left over by the others, and may be empty.
    """
    t, n = tables(), len(symbols)
    lead = n % BLOCK
    codes = symbols[lead:].reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1)) if n > lead else np.zeros(0, np.int64)
    borders, cost = [vector], 0
    follow, add = t.steps[BLOCK]
    for code in codes[::-1].tolist():
        cost += int(add[vector, code])
        vector = int(follow[vector, code])
        borders.append(vector)
    if lead:
        code = int(symbols[:lead] @ (SYMBOLS ** np.arange(lead - 1, -1, -1)))
        cost += int(t.steps[lead][1][vector, code])
        borders.append(int(t.steps[lead][0][vector, code]))
    else:
        borders.append(vector)
    return borders[::-1], cost


def trace(symbols: np.ndarray, borders: list[int], state: int, last: bool) -> tuple[str, int]:
    """The edits' initials from ``state`` and the state at the end; ``last`` adds what a conversation's end needs."""
    t, out, n = tables(), [], len(symbols)
    follow, lead = t.steps[1][0], n % BLOCK
    at = 0
    for k, size in enumerate([lead, *[BLOCK] * (n // BLOCK)]):
        own = symbols[at : at + size].tolist()
        behind = [borders[k + 1]]
        for x in own[:0:-1]:
            behind.append(int(follow[behind[-1], x]))
        for x, v in zip(own, reversed(behind), strict=False):
            while True:
                letter = chr(t.choice[v, x, state])
                out.append(letter)
                state = int(t.then[v, x, state])
                if letter != "I":
                    break
        at += size
    while last and state in (SYSTEM, USER):
        out.append("I")
        state = TURN[state]
    return "".join(out), state


class Digest:
    """SHA-256 of the repaired rows joined by newlines, row by row."""

    def __init__(self) -> None:
        self.sha, self.first, self.state, self.left = hashlib.sha256(), True, START, iter(())

    def begin(self, audit: str) -> None:
        """The edits of the next rows; what the last ones have left over are insertions."""
        self.finish()
        self.left = iter(audit)

    def _put(self, text: str) -> None:
        self.sha.update((text if self.first else "\n" + text).encode())
        self.first = False

    def row(self, role: str, text: str) -> None:
        for letter in self.left:
            if letter == "K":
                self.state = KEEP[self.state, "sua".find(role[:1])]
                self._put(f"{role}:{text}")
            elif letter != "D":
                self.state = TURN[self.state]
                self._put(f"{ROLE[self.state]}:{text if letter == 'R' else ''}")
            if letter != "I":
                return

    def finish(self) -> str:
        for _ in self.left:
            self.state = TURN[self.state]
            self._put(f"{ROLE[self.state]}:")
        return self.sha.hexdigest()


def _symbols(codes) -> np.ndarray:
    codes = np.asarray(codes, np.int64)
    return np.minimum(codes[codes != GONE], GO)


def _facts(turns: list, initials: list[str], codes: list[int]) -> dict:
    """Counts of a run of rows in order, dropped ones left out."""
    rows = [(t, i, c) for t, i, c in zip(turns, initials, codes, strict=True) if c != GONE]
    known = [t for t, _, _ in rows if t is not None]
    return {
        "blank": sum(c == BLANK for *_, c in rows), "duplicate": sum(c == AGAIN for *_, c in rows), "truncated": sum(4 <= c < 8 for *_, c in rows),
        "illegal": sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
        "rows": len(rows), "least": known[0] if known else None, "most": known[-1] if known else None, "turns": len(dict.fromkeys(known)),
        "head": rows[0][1] if rows else "", "tail": rows[-1][1] if rows else ""}


def _gaps(f: dict) -> int:
    return 0 if f["least"] is None else f["most"] - f["least"] + 1 - f["turns"]


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ROWS = "turn long, role string, text string, code int, key binary"


def damaged(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``conversation:turn`` modulo 20; nulls read as one space.

    0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's. A dropped row
    stays as one with ``gone``, so that its conversation is known.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col))) % 20
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), fate.alias("fate"))
    out = out.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                     F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                     (F.col("fate") == 0).alias("gone"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))
    return out.select("conv", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def _coded(rows: DataFrame) -> DataFrame:
    """``code`` without duplicates, ``key`` (a digest of role and text) and the sort key of a row."""
    end = F.rtrim("text", F.lit(WHITE))
    kind = F.coalesce(*[F.when(F.substring("role", 1, 1) == x, k) for k, x in enumerate("sua")], F.lit(3))
    code = F.when(F.col("gone"), GONE).when(end == "", BLANK).otherwise(kind + F.when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(4))
    return rows.select("conv", "turn", "role", "text", code.cast("int").alias("code"), F.md5("text").alias("tie"),
                       F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("key"), F.monotonically_increasing_id().alias("salt"))


def _by_ranges(rows: DataFrame, fragment: int) -> DataFrame:
    """Finished conversations (``frag`` null), and the rows of those that a range or a fragment cuts."""
    conv = rows.schema["conv"].dataType.simpleString()
    kind = f"conv {conv}, frag long, no int, {ROWS}, {', '.join(f'{c} long' for c in RESULT)}, audit string, repaired_sha256 string"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, out = TaskContext.get().partitionId() << 32, 0, []
        current, own, keys, cut = object(), [], set(), True

        def emit() -> None:  # the rows held so far are a fragment
            nonlocal count
            out.extend((current, part + count, no, *r, *[None] * 8) for no, r in enumerate(own))
            count += 1

        def close() -> None:
            if cut:
                if own:
                    emit()
                return
            turns, roles, texts, codes, _ = zip(*own, strict=True)
            symbols, f = _symbols(codes), _facts(list(turns), [r[:1] for r in roles], list(codes))
            borders, cost = sweep(symbols, tables().end)
            audit, _ = trace(symbols, borders, START, True)
            digest = Digest()
            digest.begin(audit)
            for role, text, code in zip(roles, texts, codes, strict=True):
                if code != GONE:
                    digest.row(role, text)
            out.append((current, None, None, *[None] * 5, _gaps(f), f["blank"], f["duplicate"], f["truncated"], f["illegal"], cost + int(tables().vectors[borders[0]][START]), audit, digest.finish()))

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) > least:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()

        first = True
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "code", "key")], strict=True):
                if first or row[0] != current:
                    if not first:
                        close()
                        yield from flush(1000)
                    # The first conversation of a range may have begun in an earlier one.
                    current, own, keys, cut, first = row[0], [], set(), first, False
                turn, role, text, code, key = row[1:]
                code = AGAIN if code < GO and key in keys else code
                keys.add(key)
                own.append((turn, role, text, code, key))
                if len(own) >= fragment:
                    emit()
                    own, keys, cut = [], set(), True
                    yield from flush(1000)
        if not first:
            cut = True  # the last one may go on in a later range
            close()
        yield from flush(0)

    order = ["conv", "turn", "role", "tie", "salt"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kind)


def _fragments(rows: DataFrame) -> DataFrame:
    """A row a fragment: its codes, counts, and costs between all pairs of states."""
    conv = rows.schema["conv"].dataType.simpleString()
    counts = ("blank", "duplicate", "truncated", "illegal", "rows", "least", "most", "turns")
    kind = f"c string, conv {conv}, frag long, codes binary, {', '.join(f'{c} long' for c in counts)}, head string, tail string, costs array<long>"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        turns = [None if pd.isna(t) else int(t) for t in pdf["turn"]]
        f, symbols = _facts(turns, list(pdf["initial"]), pdf["code"].tolist()), _symbols(pdf["code"])
        costs = []
        for q in range(4):
            borders, cost = sweep(symbols, q)
            costs += [int(min(NEVER, cost + x)) for x in tables().vectors[borders[0]]]
        head = pdf.iloc[0]
        return pd.DataFrame([(head["c"], head["conv"], head["frag"], symbols.astype(np.uint8).tobytes(), *[f[x] for x in counts], f["head"], f["tail"], costs)], columns=["c", "conv", "frag", "codes", *counts, "head", "tail", "costs"]).astype({"least": "Int64", "most": "Int64"})

    return rows.groupBy("c", "frag").applyInPandas(one, kind)


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """A conversation's fragments in order: the vector behind each, and the sums, on its first fragment's row."""
    pdf = pdf.sort_values("frag").reset_index(drop=True)
    after, ends = np.array(tables().vectors[tables().end]), []
    index = {tuple(v): i for i, v in enumerate(tables().vectors.tolist())}
    total = 0
    for costs in pdf["costs"][::-1]:
        low = int(after.min())
        total, after = total + low, after - low
        ends.append(index[tuple(after.tolist())])
        # costs[q] are those that reach state q at the fragment's end, from each state.
        after = np.min([np.asarray(costs[4 * q : 4 * q + 4]) + after[q] for q in range(4)], axis=0)
    filled = pdf[pdf["rows"] > 0]
    illegal = int(pdf["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in zip(filled["tail"], filled["head"][1:], strict=False))
    timed = pdf[pdf["least"].notna()]
    turns = int(timed["turns"].sum()) - sum(a == b for a, b in zip(timed["most"], timed["least"][1:], strict=False))
    gaps = int(timed["most"].iloc[-1] - timed["least"].iloc[0]) + 1 - turns if len(timed) else 0
    out = pdf[["c", "conv", "frag"]].assign(vector=ends[::-1], last=False)
    out.loc[len(out) - 1, "last"] = True
    sums = {"gaps": gaps, **{c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": total + int(after[START])}
    for c, value in sums.items():
        out[c] = pd.array([value, *[None] * (len(out) - 1)], "Int64")
    return out


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each state: the state that a fragment leads to, and its audit."""
    for batch in batches:
        ends, audits = [], []
        for codes, vector, last in zip(*[batch.column(c).to_pylist() for c in ("codes", "vector", "last")], strict=True):
            symbols = np.frombuffer(codes, np.uint8).astype(np.int64)
            borders, _ = sweep(symbols, vector)
            found = [trace(symbols, borders, q, last) for q in range(4)]
            audits.append([a for a, _ in found])
            ends.append([q for _, q in found])
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("frag"), pa.array(ends, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))], names=["c", "frag", "ends", "audits"])


def _enter(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each fragment of a conversation begins."""
    pdf = pdf.sort_values("frag")
    state, states = START, []
    for ends in pdf["ends"]:
        states.append(state)
        state = int(ends[state])
    return pdf[["c", "frag"]].assign(state=states)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation: a fragment's audit comes in front of its rows."""
    current, digest, audits = None, None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.string()), pa.array(["".join(audits)], pa.string()), pa.array([digest.finish()], pa.string())], names=["c", "audit", "repaired_sha256"])

    for batch in batches:
        for c, no, role, text, audit in zip(*[batch.column(k).to_pylist() for k in ("c", "no", "role", "text", "audit")], strict=True):
            if c != current:
                if digest is not None:
                    yield row()
                current, digest, audits = c, Digest(), []
            if no < 0:
                digest.begin(audit)
                audits.append(audit)
            else:
                digest.row(role, text)
    if digest is not None:
        yield row()


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False, fragment: int = FRAGMENT) -> DataFrame:
    """A row a conversation: gaps, counts of faults, cost and audit of the cheapest edits, digest of the repaired rows.

    With ``damage``, faults are planted first (:func:`damaged`). Null roles and texts read as one space. Rows go by
    turn, nulls first; those of one turn by role, then by the MD5 of the text; repeated rows are rows of their own,
    all but the first duplicates. A null id is one conversation. One without any row left has zeros, an empty audit
    and the digest of nothing. No rows give no rows; other columns are not looked at. Role and text are compared by
    a 128-bit digest.
    """
    named = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    whole = damaged(rows, **named) if damage else rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))], F.lit(False).alias("gone"))
    results = [*RESULT, "audit", "repaired_sha256"]
    done = materialize(_by_ranges(_coded(whole), fragment), "conversations")
    c = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    cut = done.where("frag IS NOT NULL").select(c.alias("c"), "conv", "frag", "no", "turn", "role", "text", "code", "key")
    # A fragment's own repeats are marked; of the others, those that an earlier fragment has.
    fresh = cut.where(F.col("code") < GO).select("c", "key", "frag", "no")
    later = fresh.join(fresh.groupBy("c", "key").agg(F.min("frag").alias("seen")), ["c", "key"]).where("frag > seen").select("c", "frag", "no", F.lit(AGAIN).alias("again"))
    coded = cut.select("c", "conv", "frag", "no", "turn", F.substring("role", 1, 1).alias("initial"), "code").join(later, ["c", "frag", "no"], "left")
    fragments = materialize(_fragments(coded.withColumn("code", F.coalesce("again", "code")).drop("again")), "fragments")
    conv = done.schema["conv"].dataType.simpleString()
    chained = materialize(fragments.drop("codes").groupBy("c").applyInPandas(_chain, f"c string, conv {conv}, frag long, vector int, last boolean, {', '.join(f'{x} long' for x in RESULT)}"), "chained")
    traced = materialize(fragments.select("c", "frag", "codes").join(chained.select("c", "frag", "vector", "last"), ["c", "frag"]).mapInArrow(_traces, "c string, frag long, ends array<int>, audits array<string>"), "traced")
    entered = traced.select("c", "frag", "ends").groupBy("c").applyInPandas(_enter, "c string, frag long, state int")
    spans = traced.join(entered, ["c", "frag"]).select("c", "frag", F.lit(-1).alias("no"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.element_at("audits", F.col("state") + 1).alias("audit"))
    kept = cut.where(F.col("code") != GONE).select("c", "frag", "no", "role", "text", F.lit(None).cast("string").alias("audit"))
    told = spans.unionByName(kept).repartition("c").sortWithinPartitions("c", "frag", "no").mapInArrow(_digests, "c string, audit string, repaired_sha256 string")
    rest = chained.where("cost IS NOT NULL").join(told, "c").select("conv", *results)
    return done.where("frag IS NULL").select("conv", *results).unionByName(rest).withColumnRenamed("conv", conv_col)
