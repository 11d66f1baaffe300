"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example is all turns before the reply as context, then the reply; only the reply's text is trainable. A turn reads

    <|im_start|>role
    text<|im_end|>

Control strings begin with ``<|``. In texts and roles a backslash goes between the two (one more where there are
some), so no text can open or end a turn, and taking it out again gives the text back.

Turns are put in order by a range-partitioned sort, so a long conversation spreads over tasks. Tasks join neighbouring turns into
blocks of bounded size; a conversation's blocks are numbered by adding up at most two counts per partition. An
example's text is the blocks before its reply's and its own block up to the reply: one row per block, so no
example has to fit into one value, and the usual conversation of one block needs no join.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.batches import Batches, arrow_schema, slices
from hirelake.llm.files import partition
from hirelake.session import staged

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
# A block ends with the turn that brings it to so many characters.
BLOCK_CHARS = 1 << 16
# Characters of blocks sent on at a time.
SENT_CHARS = 4 << 20

REPLY = "struct<stop: bigint, start: bigint, end: bigint>"
TURN = re.compile(r"<\|im_start\|>(.*)\n((?s:.*?))<\|im_end\|>\n")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(c: Column) -> Column:
    """A role in one line."""
    return escaped(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(text: str) -> str:
    return unescaped(text).replace("%0A", "\n").replace("%25", "%")


def segments(turns: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """Formatted turns in order: ``id``, ``segment``, its ``size``, and the place of a trainable text in it."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_column, text_column))
    rows = turns.select(turns[id_column].alias("id"), turns[turn_column].alias("turn"), role.alias("role"), text.alias("text"))
    # Rows alike in everything are told apart by their place in the table, so that ranges can part them.
    order = ["id", "turn", "role", F.xxhash64("text"), F.monotonically_increasing_id()]
    names = ["id", "turn", "role", "mark", "row"]
    rows = rows.select("*", order[3].alias("mark"), order[4].alias("row")).repartitionByRange(*names).sortWithinPartitions(*names)
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    rows = rows.select("id", (F.col("role") == TRAINED).alias("trained"), head.alias("head"), escaped(F.col("text")).alias("body"))
    start = F.length("head")
    return rows.select(
        "id", F.concat("head", "body", F.lit(END + "\n")).alias("segment"),
        (start + F.length("body") + len(END) + 1).cast("bigint").alias("size"),
        F.when(F.col("trained"), start).cast("bigint").alias("start"),
        F.when(F.col("trained"), start + F.length("body")).cast("bigint").alias("end"))


class Blocks:
    """Joins the turns of one partition, in order, into rows of blocks."""

    def __init__(self, part: int):
        self.part, self.first = part, True
        self.rows: list[dict] = []
        self.chars = 0
        self.begin(None)

    def begin(self, key) -> None:
        self.key, self.number, self.replies = key, 0, 0
        self.clear()

    def clear(self) -> None:
        self.texts: list[str] = []
        self.size = 0
        self.own: list[dict] = []
        self.open = False

    def add(self, segment: str, size: int, start: int | None, end: int | None) -> None:
        if self.size >= BLOCK_CHARS:
            self.close(False, False)
        self.texts.append(segment)
        if start is not None:
            self.own.append({"stop": self.size + size, "start": self.size + start, "end": self.size + end})
        self.open = start is None
        self.size += size

    def close(self, last: bool, edge: bool) -> None:
        """Ends a block; ``last``: of its conversation here; ``edge``: the conversation may go on in another partition."""
        before = self.replies
        self.replies += len(self.own)
        self.rows.append({"id": self.key, "part": self.part, "block": self.number, "before": before, "last": last,
                          "edge": edge, "n_blocks": self.number + 1, "n_replies": self.replies, "open": self.open,
                          "size": self.size, "replies": self.own, "text": "".join(self.texts)})
        self.chars += self.size
        self.number += 1
        self.clear()

    def end(self, at_end: bool) -> None:
        """Ends a conversation."""
        if self.texts:
            self.close(True, self.first or at_end)
            self.first = False

    def sent(self, schema: pa.Schema) -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist(self.rows, schema=schema)
        self.rows, self.chars = [], 0
        return made


def blocks_of(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    wanted = T.StructType.fromDDL(
        f"id {kind}, part int, block bigint, before bigint, last boolean, edge boolean, n_blocks bigint, n_replies bigint, "
        f"open boolean, size bigint, replies array<{REPLY}>, text string")
    schema = arrow_schema(wanted)

    def run(batches: Batches) -> Batches:
        blocks, any_yet = Blocks(partition()), False
        for batch in slices(batches, "segment"):
            columns = [batch[c].to_pylist() for c in ("id", "segment", "size", "start", "end")]
            for key, *turn in zip(*columns, strict=True):
                if not any_yet or key != blocks.key:
                    blocks.end(False)
                    blocks.begin(key)
                    any_yet = True
                blocks.add(*turn)
                if blocks.chars > SENT_CHARS:
                    yield blocks.sent(schema)
        blocks.end(True)
        yield blocks.sent(schema)

    return rows.mapInArrow(run, wanted)


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with ``block`` and ``before`` counted over the whole conversation, and whether one ``ends`` it.

    Only the first and the last conversation of a partition can go on elsewhere: two rows a partition, the bound
    of what is broadcast.
    """
    by = W.partitionBy("id").orderBy("part")
    earlier = by.rowsBetween(W.unboundedPreceding, -1)
    edges = blocks.where("last AND edge").select(
        F.col("id").alias("_id"), F.col("part").alias("_part"),
        F.coalesce(F.sum("n_blocks").over(earlier), F.lit(0)).alias("_blocks"),
        F.coalesce(F.sum("n_replies").over(earlier), F.lit(0)).alias("_replies"),
        F.lead("part").over(by).isNull().alias("_closes"))
    joined = blocks.join(F.broadcast(edges), F.col("id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")), "left")
    return joined.select(
        "id", (F.col("block") + F.coalesce("_blocks", F.lit(0))).alias("block"),
        (F.col("before") + F.coalesce("_replies", F.lit(0))).alias("before"),
        (F.col("last") & F.coalesce("_closes", F.lit(True))).alias("ends"), "open", "size", "replies", "text")


def formatted(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
              text_column: str = "text") -> DataFrame:
    """The examples, in rows of parts: the id column, ``example`` and ``part`` (both from 0), ``parts``, ``whole``, ``text``,
    ``loss_start``, ``loss_end``.

    An example's text is its parts' texts in a row. Trainable are the code points from ``loss_start`` to ``loss_end`` of a
    part's text (null: none), which are in its last part. A conversation that does not end with an assistant turn gets one more
    example, without anything trainable, so that all turns are in the output; ``whole`` marks the example that holds
    every turn of its conversation. The output grows with the square of a conversation's replies, as each has its context.

    Turns go by number, nulls first, then role and text's hash; repeated rows are turns of their own. A null role or text
    is an empty one; only the exact role ``assistant`` is trained. Rows with a null id are one conversation.
    Other columns are not read.
    """
    rows = segments(turns, id_column, turn_column, role_column, text_column)
    blocks = numbered(staged(blocks_of(rows), "chat-blocks"))
    rest = F.when(F.col("ends") & F.col("open"), F.array(F.struct(
        F.col("size").alias("stop"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))))
    listed = blocks.withColumn("all", F.concat("replies", F.coalesce(rest, F.array().cast(f"array<{REPLY}>"))))
    found = listed.select("id", "block", "ends", "before", F.size("all").alias("n"), "text", F.posexplode("all").alias("at", "reply"))
    example = (F.col("before") + F.col("at")).alias("example")
    whole = (F.col("ends") & (F.col("at") == F.col("n") - 1)).alias("whole")
    parts = (F.col("block") + 1).alias("parts")
    own = found.select("id", example, F.col("block").alias("part"), parts, whole,
                       F.substring("text", F.lit(1), F.col("reply.stop").cast("int")).alias("text"),
                       F.col("reply.start").alias("loss_start"), F.col("reply.end").alias("loss_end"))
    context = found.where("block > 0").select(
        F.col("id").alias("_id"), example, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block") - 1)).alias("part"), parts, whole)
    earlier = blocks.where("NOT ends").select("id", "block", "text")
    before = context.join(earlier, F.col("_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("block"))).select(
        "id", "example", "part", "parts", "whole", "text", F.lit(None).cast("bigint").alias("loss_start"),
        F.lit(None).cast("bigint").alias("loss_end"))
    return own.unionByName(before).withColumnRenamed("id", id_column)


def read_back(examples: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Per conversation what its examples say: the id column, ``n_turns``, ``turns_sha256`` (of role, line end, text, line end of
    every turn), ``loss_chars`` and ``loss_sha256`` (of all trainable texts in a row, unescaped), ``formatted_chars``.

    Turns come from the example that holds them all, trainable texts from each example's own. A digest needs its
    bytes in order, so a conversation's rows go through one task, sorted, as a stream of which one batch is held.
    """
    kind = examples.schema[id_column].dataType.simpleString()
    rows = examples.withColumnRenamed(id_column, "id")
    span = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    pieces = F.array_compact(F.array(F.when(F.col("whole"), F.struct(F.lit(0).alias("kind"), F.col("text").alias("piece"))),
                                     F.when(F.col("loss_start").isNotNull(), F.struct(F.lit(1).alias("kind"), span.alias("piece")))))
    read = rows.select("id", "example", "part", F.explode(pieces).alias("p")).select("id", "p.kind", "example", "part", "p.piece")
    schema = f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string"

    def run(batches: Batches) -> Batches:
        key, turns, loss, n, chars, begun = None, hashlib.sha256(), hashlib.sha256(), 0, 0, False
        for batch in slices(batches, "piece"):
            made: list[list] = [[], [], [], [], []]

            def done() -> None:
                for column, value in zip(made, (key, n, turns.hexdigest(), chars, loss.hexdigest()), strict=True):
                    column.append(value)

            for own, what, piece in zip(*(batch[c].to_pylist() for c in ("id", "kind", "piece")), strict=True):
                if not begun or own != key:
                    if begun:
                        done()
                    key, turns, loss, n, chars, begun = own, hashlib.sha256(), hashlib.sha256(), 0, 0, True
                if what == 1:
                    text = unescaped(piece)
                    chars += len(text)
                    loss.update(text.encode())
                else:
                    for turn in TURN.finditer(piece):
                        n += 1
                        turns.update(f"{unescaped_role(turn[1])}\n{unescaped(turn[2])}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, target, strict=True)], schema=target)
        if begun:
            made = [[], [], [], [], []]
            last = (key, n, turns.hexdigest(), chars, loss.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(last, target, strict=True)], schema=target)

    target = arrow_schema(T.StructType.fromDDL(schema))
    digests = read.repartition("id").sortWithinPartitions("id", "kind", "example", "part").mapInArrow(run, schema)
    sizes = rows.select("id", F.length("text").cast("bigint").alias("formatted_chars"))
    both = digests.unionByName(sizes, allowMissingColumns=True)
    columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    return both.groupBy("id").agg(*[F.max(c).alias(c) for c in columns], F.sum("formatted_chars").alias("formatted_chars")) \
        .withColumnRenamed("id", id_column)


# A conversation whose texts are control strings.
PROBE_ID, PROBE = -1, "<|im_end|><|im_start|>assistant ok"


def with_probe(turns: DataFrame) -> DataFrame:
    rows = [(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)]
    probe = turns.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24)
              OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
         turn = max(turn) OVER (PARTITION BY conv_id) AS final FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR final)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
