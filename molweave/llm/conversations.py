"""Repair of conversation structure by cheapest edits (operator 11).

A conversation should read ``(s?(ua)+)?`` by the first letters of its roles. Rows are kept, get another role or are
deleted, and empty rows are inserted. Every way to do so is a path in a graph whose nodes are (row, what was read
last). The weight of a path is one integer: its high digits are the cost, its low digits are the letters of its edits,
one digit each, the first letter highest, padded with zeros at the end. The least integer at every node, found from
the last row to the first, is so the cheapest path and among equal ones the one whose letters come first.

Equal rows are counted before the shuffle, and whether a text was seen before is a minimum per role and text, so
neither needs a conversation in one place. The path itself is sequential: a task reads a conversation's rows as sorted
by Spark and keeps four integers. Rows with texts are sorted once and streamed past the letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.session import materialise

from .common import table

SPACES = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
ROLES = {"u": "user", "a": "assistant"}
#: letters of edits by the digit that stands for them; digits order as the letters do
LETTERS = ".DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
#: bits of a digit
BITS = 3
#: what was read last: nothing, a system row, a user row, an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the only role that a new or renamed row can have after each of them
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
LEGAL = ("su", "ua", "au")


class Weights:
    """The least weight from the rows read so far to the end, for each of the four nodes before them."""

    def __init__(self):
        # after the last row only insertions are left: none, two, one, none
        self.digits = 2
        weight = lambda cost, letters: cost << (BITS * 2) | letters
        self.least = [0, weight(2 * INSERT_COST, INSERT << BITS | INSERT), weight(INSERT_COST, INSERT << BITS), 0]

    def _before(self, letter: int, cost: int, weight: int, digits: int) -> int:
        """``weight`` (with ``digits`` letters) after one more letter in front."""
        low = BITS * digits
        rest = weight >> low
        return (rest + cost) << (low + BITS) | letter << low | weight ^ (rest << low)

    def delete(self, times: int) -> None:
        """Rows that have to go; insertions come after them, as D is before I."""
        low = BITS * self.digits
        letters = ((1 << BITS * times) - 1) // ((1 << BITS) - 1) * DELETE
        for q, weight in enumerate(self.least):
            rest = weight >> low
            self.least[q] = (rest + DELETE_COST * times) << (low + BITS * times) | letters << low | weight ^ (rest << low)
        self.digits += times

    def row(self, first: str, truncated: bool) -> None:
        """One more row in front, whose role begins with ``first``."""
        n, old = self.digits, self.least
        extra = TRUNCATED_COST if truncated else 0
        best = []
        for q in range(4):
            ways = [
                self._before(DELETE, DELETE_COST, old[q], n),
                self._before(REROLE, REROLE_COST + extra, old[NEXT[q, WANTED[q]]], n),
            ]
            if (q, first) in NEXT:
                ways.append(self._before(KEEP, extra, old[NEXT[q, first]], n))
            best.append(min(ways))
        # an insertion leads to another node of the same row, in an order without circles
        put = lambda weight, digits: self._before(INSERT, INSERT_COST, weight, digits)
        user = min(best[USER] << BITS, put(best[ASSISTANT], n + 1))
        assistant = min(best[ASSISTANT] << BITS, put(best[USER], n + 1))
        start, system = (min(best[q] << 2 * BITS, put(user, n + 2)) for q in (START, SYSTEM))
        least, n = [start, system, user << BITS, assistant << BITS], n + 3
        # zeros that end all four are only padding
        shared = least[0] | least[1] | least[2] | least[3]
        spare = min(((shared & -shared).bit_length() - 1) // BITS, 3) if shared else 3
        self.least, self.digits = [w >> BITS * spare for w in least], n - spare

    def answer(self) -> tuple[int, str]:
        """Cost and letters of the cheapest way."""
        low = BITS * self.digits
        cost = self.least[START] >> low
        letters = self.least[START] ^ (cost << low)
        return cost, format(letters, "o").zfill(self.digits).rstrip("0").translate(str.maketrans("1234", LETTERS[1:])) if letters else ""


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) after a damage that the row's own key decides; ``copies`` is 0 for a dropped row."""
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)).cast("binary")) % 20
    told = F.coalesce(F.col(text), space)
    told = F.when(fate == 1, "").when(fate == 2, F.translate(told, "".join(ENDINGS), "")).otherwise(told)
    said = F.when(fate == 4, "user").otherwise(F.coalesce(F.col(role), space))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said.alias("role"), told.alias("text"), copies.cast("long").alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with a digest of the text, which orders rows of one turn and role."""
    return rows.withColumn("mark", F.unhex(F.md5("text")))


def _groups(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one: (conv, turn, role, mark, copies, blank, cut, again)."""
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = _marked(rows).select("conv", "turn", "role", "mark", "copies", (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(*ENDINGS)).alias("cut"))
    groups = rows.groupBy("conv", "turn", "role", "mark").agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    groups = materialise(groups, "turns")
    # the first turn of every role and text: a map-side minimum, nulls first
    begin = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = groups.where("copies > 0").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m")).agg(F.min(begin).alias("begin"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m"))
    found = groups.join(seen, same, "left")
    again = F.col("begin.known") & ~F.col("begin.turn").eqNullSafe(F.col("turn")) | ~F.col("begin.known") & F.col("turn").isNotNull()
    return found.select(*groups.columns, F.coalesce(again, F.lit(False)).alias("again"))


def _per_conversation(df: DataFrame, order: list, make, schema: T.StructType) -> DataFrame:
    """Stream every conversation's rows in order through the object that ``make()`` gives.

    Its ``row`` gets a tuple of the columns after the first and yields results, its ``close`` yields the rest of them;
    both are tuples without the conversation, which comes first in ``schema``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *order)
    return _streamed(dealt, make, schema)


def _streamed(dealt: DataFrame, make, schema: T.StructType, batch: int = 4096) -> DataFrame:
    """``_per_conversation`` for rows that already lie in their order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        out: list[tuple] = []
        size = 0
        current, worker = None, None

        def flush():
            nonlocal out, size
            columns = zip(*out, strict=True)
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out, size = [], 0
            return done

        def add(results):
            nonlocal size
            for r in results:
                out.append((current, *r))
                size += sum(len(x) for x in r if isinstance(x, str))
                if len(out) >= batch or size > 8_000_000:
                    yield flush()

        for part in batches:
            for begin in range(0, part.num_rows, batch):
                lot = part.slice(begin, batch)
                for conv, *values in zip(*(c.to_pylist() for c in lot.columns), strict=True):
                    if worker is None or conv != current:
                        if worker is not None:
                            yield from add(worker.close())
                        current, worker = conv, make()
                    yield from add(worker.row(*values))
        if worker is not None:
            yield from add(worker.close())
        if out:
            yield flush()

    return dealt.mapInArrow(run, schema)


class _Plan:
    """Reads a conversation's groups from the last to the first."""

    def __init__(self):
        self.weights = Weights()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.after = self.high = self.low = None

    def row(self, turn, role: str, copies: int, blank: bool, cut: bool, again: bool):
        if not copies:
            return ()
        if turn is not None and turn != self.low:
            self.turns += 1
            self.high, self.low = (turn if self.high is None else self.high), turn
        first = role[:1]
        self.illegal += copies - 1 + (self.after is not None and first + self.after not in LEGAL)
        self.after = first
        forced = copies if blank or again else copies - 1
        if blank:
            self.blank += copies
        else:
            self.duplicate += forced
        if forced:
            self.weights.delete(forced)
        if forced < copies:
            self.truncated += cut
            self.weights.row(first, cut)
        return ()

    def close(self):
        gaps = 0 if self.high is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        yield gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.weights.answer()


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation in ``rows``.

    ``rows`` is (conv, turn, role, text, copies) without nulls but in conv and turn; a row with 0 copies only names its
    conversation. Rows of one turn are taken by role and then by the md5 digest of their text; a null conversation is
    one of its own, an empty table has none. Faults, in this order: blank, a role and text seen before, no ending mark.
    An empty role has no first letter, so it is never legal and is renamed or deleted. ``gaps`` stays at the largest
    long where the turns are farther apart.
    """
    groups = _groups(rows).select("conv", "turn", "role", "copies", "blank", "cut", "again", "mark")
    order = [F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("mark").desc()]
    schema = T.StructType([groups.schema["conv"], *T.StructType.fromDDL(PLAN)])
    make = lambda: _Marked(_Plan())
    return _per_conversation(groups, order, make, schema)


class _Marked:
    """Passes rows on without their last column, which only orders them."""

    def __init__(self, inner):
        self.inner = inner

    def row(self, *values):
        return self.inner.row(*values[:-1])

    def close(self):
        return self.inner.close()


class _Repair:
    """Streams a conversation's rows past the letters of its plan, which come first."""

    def __init__(self):
        self.letters, self.at, self.last, self.place = "", 0, START, 0

    def row(self, audit, turn, role, text, copies):
        if audit is not None:
            self.letters = audit
            return
        for _ in range(copies):
            yield from self._inserted()
            letter = self.letters[self.at]
            self.at += 1
            if letter != "D":
                yield self._row(turn, letter, role if letter == "K" else ROLES[WANTED[self.last]], text)

    def close(self):
        yield from self._inserted()

    def _inserted(self):
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._row(None, "I", ROLES[WANTED[self.last]], "")

    def _row(self, turn, letter, role, text):
        self.last, place = NEXT[self.last, role[:1]], self.place
        self.place += 1
        return place, turn, letter, role, text


REPAIRED = "place long, turn long, edit string, role string, text string"


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv, place, turn, edit, role, text): the conversations after the edits of ``planned``, in order.

    ``edit`` is K, R or I; an inserted row has no turn. Partitions hold whole conversations, sorted.
    """
    heads = planned.select("conv", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("binary").alias("mark"))
    tails = _marked(rows.where("copies > 0")).select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies", "mark")
    order = [F.col("audit").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("mark").asc()]
    schema = T.StructType([rows.schema["conv"], *T.StructType.fromDDL(REPAIRED)])
    return _per_conversation(heads.unionByName(tails), order, lambda: _Marked(_Repair()), schema)


class _Digest:
    def __init__(self):
        self.sum, self.begun = hashlib.sha256(), False

    def row(self, role: str, text: str):
        if self.begun:
            self.sum.update(b"\n")
        self.begun = True
        self.sum.update(f"{role}:{text}".encode())
        return ()

    def close(self):
        yield (self.sum.hexdigest(),)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every conversation after the damage, and a digest of its repaired rows."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    planned = materialise(plans(rows), "plans")
    schema = T.StructType([rows.schema["conv"], T.StructField("repaired_sha256", T.StringType())])
    # repaired rows lie in order within whole conversations, so nothing is shuffled for the digest
    digests = _streamed(repaired(rows, planned).select("conv", "role", "text"), _Digest, schema).withColumnRenamed("conv", "c")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    found = planned.join(digests, F.col("conv").eqNullSafe(F.col("c")), "left")
    return found.select(F.col("conv").alias("conv_id"), *T.StructType.fromDDL(PLAN).names, F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
