"""Conversation structure repair over a suffix-shared automaton (DAWG).

A conversation is legal when its role initials read ``(s?(ua)+)?``.  Edits of a
row: Keep (0), Rerole to user or assistant (3), Delete (4); an empty user or
assistant row may be Inserted anywhere (3).  Blank and duplicate rows must be
deleted; a truncated row that stays costs 3 more.  The cheapest edits win, of
equal cost those whose initials (D, I, K, R) are ASCII-least.

1. Every row becomes one sign: its role initial and fault.  A conversation is
   the word of its rows' signs, its signature; equal signatures are one.
2. Signatures are sorted from their last sign backwards, over many tasks by
   range.  Neighbours share their longest common suffix, so the automaton is
   built from the end: a state is a suffix, made once for all signatures that
   end in it.  A state holds, for each of the four states of the grammar, the
   least cost to the end and the first edit of the best audit; the rest of the
   audit is the state that this edit leads to.  A grammar state has one legal
   next role, so an edit's initial decides where it leads and the first least
   initial is also the first of the least audit.
3. An audit is read off the states from the front, given to all conversations
   of that signature, and applied to their rows, streamed in order into the hash.

The role and text seen first are found by an aggregate, so copies of one row are
split over tasks.  By contract a conversation has one audit and one hash over all
its texts: its rows pass one task in order, which holds a byte a row, not texts.

Defined results: null roles, texts, ids and turns read as one blank; a null turn
comes first and a null conv_id is a conversation.  Rows of the same turn come by
role, then by SHA-256 of role and text; equal rows stand together.  An empty
role has no initial and is never legal.  Long texts are never gathered.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import join_classes
from docaudit.session import cut_lineage

#: The six blanks.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after s, after u, after a.  Each has one role that may be written next, and where it leads.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
WRITES = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
LEADS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
FINAL = (EMPTY, ASSISTANT)
NEVER = 1 << 62

#: Signs of a row: the role initial (x for all others), in capitals when truncated; d when it must go.
SIGNS = "suaxSUAXd"

Node = list[tuple[int, str, int, int]]  # for each grammar state: cost, first edit, signs it uses, next grammar state


def _with_inserts(node: Node) -> Node:
    """Inserts lead to another grammar state at the same place; of equal cost the least initial stays."""
    for _ in range(3):
        for q in range(4):
            to = LEADS[WRITES[q]]
            cost = node[to][0] + INSERT
            if cost < node[q][0] or (cost == node[q][0] and cost < NEVER and "I" < node[q][1]):
                node[q] = (cost, "I", 0, to)
    return node


def end_node() -> Node:
    """The state of the empty suffix."""
    return _with_inserts([(0 if q in FINAL else NEVER, "~" if q in FINAL else "", 0, q) for q in range(4)])


def node_before(sign: str, after: Node) -> Node:
    """The state of a suffix: ``sign``, then the suffix of ``after``."""
    node: Node = []
    role, extra = sign.lower(), TRUNCATED if sign.isupper() else 0
    for q in range(4):
        ways = [(after[q][0] + DELETE, "D", 1, q)]
        if sign != "d":
            if role == WRITES[q] or (role == "s" and q == EMPTY):
                ways.append((after[LEADS[role]][0] + KEEP + extra, "K", 1, LEADS[role]))
            ways.append((after[LEADS[WRITES[q]]][0] + REROLE + extra, "R", 1, LEADS[WRITES[q]]))
        node.append(min(ways, key=lambda w: (w[0], w[1])))
    return _with_inserts(node)


class SuffixAutomaton:
    """States along one suffix path; the next signature keeps those of the suffix that it shares with the last."""

    def __init__(self):
        self.path, self.last, self.made = [end_node()], "", 0

    def repair(self, signature: str) -> tuple[int, str]:
        """(cost, audit).  Signatures in order of their reversed text make every state once."""
        signs = signature[::-1]
        shared, most = 0, min(len(signs), len(self.last))
        if signs[:most] == self.last[:most]:
            shared = most
        else:
            low, high = 0, most  # signs agree below low, differ within high
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if signs[:mid] == self.last[:mid] else (low, mid)
            shared = low
        del self.path[shared + 1 :]
        for sign in signs[shared:]:
            self.path.append(node_before(sign, self.path[-1]))
        self.made += len(signs) - shared
        self.last = signs
        at, q, audit = len(signs), EMPTY, []
        cost = self.path[at][EMPTY][0]
        while True:
            _, edit, used, to = self.path[at][q]
            if edit == "~":
                break
            audit.append(edit)
            at, q = at - used, to
        return cost, "".join(audit)


def damage(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped, copy) after the planted damage; dropped rows stay, marked."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = df.select("conv_id", "turn", said[2].alias("role"), said[3].alias("text"), (F.crc32(F.concat_ws(":", said[0], said[1])) % 20).alias("kind"))
    kind = F.col("kind")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _sign(role: Column, text: Column, first: Column) -> Column:
    stripped = F.rtrim(text, F.lit(BLANKS))
    initial = F.left(role, F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when((stripped == "") | ~first, F.lit("d")).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), known).otherwise(F.upper(known))


def _in_order(df: DataFrame, *last: str) -> DataFrame:
    """A conversation's rows in one task, in order.  Spark sorts nulls first."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *last)


def _reports(kind: str):
    """Counts and signature of every conversation, from its rows in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = False
        conv = None
        state: dict = {}
        rows: list[tuple] = []

        def close() -> None:
            low, high, turns = state["low"], state["high"], state["turns"]
            gaps = 0 if turns == 0 else high - low + 1 - turns
            rows.append((conv, gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], "".join(state["signs"])))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [kind_type, *[pa.int64()] * 5, pa.string()]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"])
            rows.clear()
            return got

        kind_type = pa.null()
        for batch in batches:
            kind_type = batch.schema.field("conv_id").type
            values = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "sign", "blank", "dropped")]
            for c, turn, initial, sign, blank, dropped in zip(*values):
                if not open_ or c != conv:
                    if open_:
                        close()
                    open_, conv = True, c
                    state = {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "signs": [], "before": None}
                if dropped:
                    continue
                if turn is not None and turn != state["high"]:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"] = turn
                    state["turns"] += 1
                if sign == "d":
                    state["blank" if blank else "duplicate"] += 1
                elif sign.isupper():
                    state["truncated"] += 1
                if state["before"] is not None and state["before"] + initial not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["before"] = initial
                state["signs"].append(sign)
            if len(rows) >= 5000:
                yield flush()
        if open_:
            close()
        if rows:
            yield flush()

    return task, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton()
    for batch in batches:
        found = [automaton.repair(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("signature"), batch.column("rows"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            ["signature", "rows", "cost", "audit"],
        )


class _Repaired:
    """Hash of a conversation's repaired rows, fed in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.any = audit, 0, EMPTY, hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8"))
        self.any = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role = WRITES[self.state]
            self._write(NAMES[role], "")
            self.at, self.state = self.at + 1, LEADS[role]

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._write(role, text)
            self.state = LEADS[role[:1]]
        elif edit == "R":
            new = WRITES[self.state]
            self._write(NAMES[new], text)
            self.state = LEADS[new]

    def hex(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


#: Counts that go with a conversation.
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _hashes(kind: str):
    """One row a conversation from its report (first) and its rows in order."""
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repaired: _Repaired | None = None
        report: tuple = ()
        rows: list[tuple] = []
        types: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return got

        for batch in batches:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            columns = [batch.column(c).to_pylist() for c in ("conv_id", *COUNTS, "audit", "role", "text")]
            for *head, role, text in zip(*columns):
                if head[-1] is not None:
                    if repaired:
                        rows.append((*report, repaired.hex()))
                    report, repaired = tuple(head), _Repaired(head[-1])
                elif repaired:
                    repaired.row(role, text)
            if len(rows) >= 5000:
                yield flush()
        if repaired:
            rows.append((*report, repaired.hex()))
            yield flush()

    return task, f"conv_id {kind}, {', '.join(c + ' long' for c in COUNTS)}, audit string, repaired_sha256 string"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for every conv_id of (conv_id, turn, role, text, dropped, copy): counts, cost, audit and hash of the repaired conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    digest = F.sha2(F.concat_ws(":", "role", "text"), 256)
    kept = cut_lineage(rows.withColumn("digest", digest).withColumn("uid", F.monotonically_increasing_id()), "turns")
    order = F.struct("turn", "uid")
    same = ("conv_id", "role", "digest")
    first = kept.where(~F.col("dropped")).groupBy(*same).agg(F.min(order).alias("first")).select(F.col("first.uid").alias("uid"), F.lit(True).alias("is_first"))
    light = kept.join(first, "uid", "left").select(
        "conv_id", "turn", "role", "digest", "uid", "dropped",
        F.left("role", F.lit(1)).alias("initial"),
        _sign(F.col("role"), F.col("text"), F.coalesce("is_first", F.lit(False))).alias("sign"),
        (F.rtrim("text", F.lit(BLANKS)) == "").alias("blank"),
    )
    task, schema = _reports(kind)
    reports = cut_lineage(_in_order(light, "turn", "role", "digest", "uid").select("conv_id", "turn", "initial", "sign", "blank", "dropped").mapInArrow(task, schema), "turn-reports")
    words = cut_lineage(reports.groupBy("signature").agg(F.count(F.lit(1)).alias("rows")).withColumn("reversed", F.reverse("signature")), "signatures")
    audits = words.repartitionByRange("reversed").sortWithinPartitions("reversed").select("signature", "rows").mapInArrow(_audits, "signature string, rows long, cost long, audit string")
    told = join_classes(reports, cut_lineage(audits, "audits"), ["signature"], "rows", "inner").select("conv_id", *COUNTS, "audit")
    empty = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    lines = kept.where(~F.col("dropped")).select("conv_id", *empty, F.lit(None).cast("string").alias("audit"), F.lit(1).alias("k"), "turn", "role", "digest", "uid", "text")
    heads = told.select("conv_id", *COUNTS, "audit", F.lit(0).alias("k"), *[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "uid", "text")])
    task, schema = _hashes(kind)
    both = _in_order(heads.unionByName(lines), "k", "turn", "role", "digest", "uid")
    return both.select("conv_id", *COUNTS, "audit", "role", "text").mapInArrow(task, schema)


def conversation_repair(df: DataFrame) -> DataFrame:
    """The planted damage, then its repair: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    return repair_conversations(damage(df))
