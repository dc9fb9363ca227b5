"""Conversation structure repair: the cheapest edits that make the roles alternate.

Each conversation's rows are taken by turn (nulls first; equal turns by role, then text). A row is
blank, a duplicate of an earlier role and text, or truncated; the first that holds counts. Edits go
through the rows: D(elete) 4, I(nsert) an empty user or assistant row 3, K(eep) 0, R(erole) 3, and 3
more for a truncated row that stays; blank and duplicate rows must go. The roles that remain must
read ``(s?(ua)+)?`` by their initials. Of the cheapest edits the ASCII-least string of initials wins.

Search: iterative-deepening A* in ASCII edit order with a table of failed states (row, grammar state
-> budget that failed). A conversation of over ``SEGMENT`` rows is searched in segments, once for
each grammar state at either end; the cheapest way to each state, and of equals the ASCII-least, is
carried from segment to segment. That is exact: two edit strings of equal cost over the same rows
are never prefixes of each other, so what follows cannot reverse their order.

Spark deals rows out by conversation and content to mark duplicates, then by conversation, sorted;
rows stream through the search. For a conversation a task holds one byte a row, the edits, and the
rows' roles and texts in a file that moves from memory to disk when it grows; no size ends it.

Null role or text: one space. Null conversation: a conversation of its own. Repeated rows: the
second is a duplicate. Rows that only announce their conversation (``gone``) count for nothing else;
a conversation without other rows has zeros, no edits and the hash of nothing. Empty table: no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deskloom.llm.prefix_trie import CRC32

#: Rows that one search covers.
SEGMENT = 16
#: Rows of a block within which the search's lower bound is exact.
PATTERN = 8
#: Bytes of a conversation's rows that stay in memory.
IN_MEMORY = 1 << 22
#: Repaired rows in one output batch.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 22

DELETE, INSERT, KEEP, REROLE = 4, 3, 0, 3
#: What a truncated row costs if it stays.
STAY = 3
WHITE = " \t\n\v\f\r"
#: Flags of a row above its role: must go; truncated.
BAD, SHORT = 4, 8
ROLES = {"s": 0, "u": 1, "a": 2}
#: Grammar states: nothing yet, after s, after u, after a. Next state by role; None: not allowed.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = ((AFTER_S, AFTER_U, None, None), (None, AFTER_U, None, None), (None, None, AFTER_A, None), (None, AFTER_U, None, None))
#: The state that a user or assistant row leads to.
TURN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
FINAL = frozenset((START, AFTER_A))

FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _bounds(codes: bytes, exits: frozenset[int]) -> list[list[int]]:
    """Lower bounds of the cost from each row and state on: additive over blocks of ``PATTERN`` rows.

    Within a block the bound is exact; what comes after the block may begin in any state.
    """
    n = len(codes)
    now = [0 if state in exits else 3 * DELETE * (n + 1) for state in range(4)]
    out = [now] * (n + 1)
    for i in range(n, -1, -1):
        if i < n:
            code, later = codes[i], min(out[i + 1]) if (i + 1) % PATTERN == 0 and i + 1 < n else None
            after = out[i + 1] if later is None else [later] * 4
            stay = STAY if code & SHORT else 0
            now = []
            for state in range(4):
                best = DELETE + after[state]
                if not code & BAD:
                    best = min(best, REROLE + stay + after[TURN[state]])
                    if (to := NEXT[state][code & 3]) is not None:
                        best = min(best, KEEP + stay + after[to])
                now.append(best)
        for _ in range(2):  # after two insertions a state comes back
            now = [min(cost, INSERT + now[TURN[state]]) for state, cost in enumerate(now)]
        out[i] = now
    return out


def search(codes: bytes, entry: int, exits: frozenset[int]) -> tuple[int, str] | None:
    """Cheapest cost and ASCII-least edits from one state before the rows to one of ``exits`` after them."""
    n, bounds = len(codes), _bounds(codes, exits)
    # Dearer than all rows out and two inserted: there is no way.
    limit, most = bounds[0][entry], DELETE * n + 3 * INSERT
    while limit <= most:
        failed: dict[int, int] = {}
        exceeded = most + 1
        # Each entry: row, state, budget left, edits still to try (ascending).
        stack = [[0, entry, limit, 0]]
        edits: list[str] = []
        failed[entry] = limit
        while stack:
            top = stack[-1]
            i, state, left, tried = top
            if not tried and i == n and state in exits:
                return limit - left, "".join(edits)
            code = codes[i] if i < n else -1
            moved = False
            while tried < 4 and not moved:
                kind, tried = tried, tried + 1
                if kind == 1:
                    cost, row, to, sign = INSERT, i, TURN[state], "I"
                elif code < 0:
                    continue
                elif kind == 0:
                    cost, row, to, sign = DELETE, i + 1, state, "D"
                elif code & BAD:
                    continue
                elif kind == 2:
                    cost, row, to, sign = (STAY if code & SHORT else KEEP), i + 1, NEXT[state][code & 3], "K"
                    if to is None:
                        continue
                else:
                    cost, row, to, sign = REROLE + (STAY if code & SHORT else 0), i + 1, TURN[state], "R"
                rest = left - cost
                need = bounds[row][to]
                if rest < need:
                    exceeded = min(exceeded, limit - rest + need)
                    continue
                key = 4 * row + to
                if failed.get(key, -1) >= rest:
                    continue
                # Marked at once: a way back to a state on the path has less budget and is no use.
                failed[key] = rest
                moved = True
            top[3] = tried
            if moved:
                edits.append(sign)
                stack.append([row, to, rest, 0])
            else:
                stack.pop()
                if stack:
                    edits.pop()
        limit = exceeded
    return None


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    if len(codes) <= SEGMENT:
        return search(codes, START, FINAL)
    ways, done = {START: (0, "")}, []
    for a in range(0, len(codes), SEGMENT):
        part, longer = codes[a : a + SEGMENT], {}
        for state, (cost, edits) in ways.items():
            for to in range(4):
                if found := search(part, state, frozenset((to,))):
                    way = (cost + found[0], edits + found[1])
                    if to not in longer or way < longer[to]:
                        longer[to] = way
        # What all ways begin with is settled.
        first, last = min(w[1] for w in longer.values()), max(w[1] for w in longer.values())
        same = next((k for k, (x, y) in enumerate(zip(first, last)) if x != y), min(len(first), len(last)))
        done.append(first[:same])
        ways = {to: (cost, edits[same:]) for to, (cost, edits) in longer.items()}
    cost, edits = min(way for to, way in ways.items() if to in FINAL)
    return cost, "".join(done) + edits


class _Conversation:
    """What a task knows of one conversation while its rows pass by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes, self.last = bytearray(), None
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.held: list[tuple[str, str]] = []
        self.bytes, self.file = 0, None

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high or self.high is None
            self.high = turn
        bare = text.rstrip(WHITE)
        code = ROLES.get(role[:1], 3)
        if not bare:
            self.blank += 1
            code |= BAD
        elif seen:
            self.duplicate += 1
            code |= BAD
        elif bare[-1] not in ".!?":
            self.truncated += 1
            code |= SHORT
        if self.last is not None:
            self.illegal += self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        self.codes.append(code)
        self.held.append((role, text))
        self.bytes += len(role) + len(text)
        if self.bytes > IN_MEMORY:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # goes when it is closed
        for pair in self.held:
            for part in pair:
                raw = part.encode()
                self.file.write(len(raw).to_bytes(8, "little") + raw)
        self.held, self.bytes = [], 0

    def _rows(self) -> Iterator[tuple[str, str]]:
        if self.file is None:
            yield from self.held
            return
        self._spill()
        self.file.seek(0)
        for _ in range(len(self.codes)):
            role, text = (self.file.read(int.from_bytes(self.file.read(8), "little")).decode() for _ in range(2))
            yield role, text
        self.file.close()

    def repaired(self) -> Iterator[tuple[str, str]]:
        """role and text of each row after the edits; sets cost and audit."""
        self.cost, self.audit = cheapest_edits(bytes(self.codes))
        rows, state = self._rows(), START
        for edit in self.audit:
            if edit == "I":
                state = TURN[state]
                yield ("user" if state == AFTER_U else "assistant"), ""
                continue
            role, text = next(rows)
            if edit == "K":
                state = NEXT[state][ROLES[role[:1]]]
                yield role, text
            elif edit == "R":
                state = TURN[state]
                yield ("user" if state == AFTER_U else "assistant"), text

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[_Conversation]:
    """The conversations of a task, complete, one after the other."""
    now = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen", "gone")]
        for conv_id, turn, role, text, seen, gone in zip(*columns, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now
                now = _Conversation(conv_id)
            if not gone:
                now.add(turn, role, text, seen)
    if now is not None:
        yield now


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    out: list[tuple] = []

    def close() -> pa.RecordBatch:
        kinds = (pa.int64(),) * 7 + (pa.string(),) * 2
        columns = zip(*out, strict=True) if out else repeat((), len(names))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    held = 0
    for c in _conversations(batches):
        digest, glue = hashlib.sha256(), b""
        for role, text in c.repaired():
            digest.update(glue + f"{role}:{text}".encode())
            glue = b"\n"
        out.append((c.conv_id, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, c.cost, c.audit, digest.hexdigest()))
        held += len(c.audit)
        if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield close()
            out, held = [], 0
    yield close()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0

    def close() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = zip(*out, strict=True) if out else repeat((), 4)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=("conv_id", "position", "role", "text")
        )

    for c in _conversations(batches):
        for position, (role, text) in enumerate(c.repaired()):
            out.append((c.conv_id, position, role, text))
            held += len(text)
            if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield close()
                out, held = [], 0
    yield close()


def _in_order(rows: DataFrame, gone: str | None) -> DataFrame:
    """conv_id, turn, role, text, seen, gone: by conversation, in the order of its rows."""
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    )
    # The rows of one content: all but the first are duplicates.
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    return (
        own.withColumn("seen", F.row_number().over(same) > 1)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")
    )


def repair_figures(rows: DataFrame, *, gone: str | None = None) -> DataFrame:
    """conv_id and the figures of its faults, cost, audit (edits) and hash of its repaired rows."""
    return _in_order(rows, gone).mapInArrow(_figures, f"conv_id long, {FIGURES}")


def repaired_turns(rows: DataFrame, *, gone: str | None = None) -> DataFrame:
    """conv_id, position, role, text of all conversations after their cheapest edits."""
    return _in_order(rows, gone).mapInArrow(_turns, "conv_id long, position long, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows with reproducible faults, by a checksum of conversation and turn.

    Of 20 remainders, 0 drops the row (it stays as ``gone``), 1 empties its text, 2 takes its sentence
    ends, 3 repeats it, 4 gives it to the user.
    """
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = (F.crc32(name) % 20).alias("kind")
    text = (
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    )
    return own.select("*", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


#: Edits by dynamic programming over rows, one step a row; the least of (cost, edits) stays for each grammar state.
SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS name FROM conversations
), faults AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind IN (0, 1) THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, kind
  FROM (SELECT *, {CRC32.format("name")} % 20 AS kind FROM named)
), copies AS (
  SELECT conv_id, turn, role, text FROM faults WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM faults WHERE kind = 3
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM copies
), marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair,
    row_number() OVER (PARTITION BY conv_id ORDER BY i) > 1 AS second
  FROM ordered
), figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (second AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), inserts(f, edits, t, added) AS (
  VALUES (0, '', 0, []), (1, '', 1, []), (2, '', 2, []), (3, '', 3, []), (0, 'I', 2, ['user:']), (1, 'I', 2, ['user:']), (2, 'I', 3, ['assistant:']),
    (3, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']), (1, 'II', 3, ['user:', 'assistant:'])
), moves(f, initial, edit, t) AS (
  VALUES (0, 's', 'K', 1), (0, 'u', 'K', 2), (1, 'u', 'K', 2), (2, 'a', 'K', 3), (3, 'u', 'K', 2),
    (0, '', 'R', 2), (1, '', 'R', 2), (2, '', 'R', 3), (3, '', 'R', 2), (0, '', 'D', 0), (1, '', 'D', 1), (2, '', 'D', 2), (3, '', 'D', 3)
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'kept': []::VARCHAR[]}} AS way FROM figures
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.t, min({{
      'cost': w.way.cost + 3 * length(x.edits) + CASE m.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
        + CASE WHEN m.edit <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END,
      'audit': w.way.audit || x.edits || m.edit,
      'kept': w.way.kept || x.added || CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
        WHEN 'R' THEN [CASE m.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END}})
  FROM ways w JOIN marked r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN inserts x ON x.f = w.state
  JOIN moves m ON m.f = x.t AND (m.edit <> 'K' OR m.initial = left(r.role, 1)) AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, w.i, m.t
), best AS (
  SELECT w.conv_id, min({{'cost': w.way.cost + 3 * length(x.edits), 'audit': w.way.audit || x.edits, 'kept': w.way.kept || x.added}}) AS way
  FROM ways w JOIN figures f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i JOIN inserts x ON x.f = w.state AND x.t IN (0, 3) GROUP BY w.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.way.cost, 0) AS cost, coalesce(b.way.audit, '') AS audit,
  sha256(coalesce(array_to_string(b.way.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
