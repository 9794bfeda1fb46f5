"""Chat formatting over prefix trees.

Conversations that share their first turns share the nodes of a tree. A tree is
laid out depth first as one packed sequence: each shared turn is emitted once,
with position ids that go on from its parent and the intervals of the sequence
(its ancestors) that it may attend to. A token here is a code point; the
intervals hold for any tokenizer that is applied turn by turn.

Equal conversations are one path of the tree. Trees of very common first turns
are cut into packs of a bounded number of conversations: the turns above a cut
are repeated once a pack, never collected in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import stage, table

#: The template's control strings (fixed); a turn is OPEN role MID text CLOSE.
OPEN, MID, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
#: Conversations in a pack on average, and the role whose text is learnt.
PACK, LEARNT = 128, "assistant"
#: Parts of a tree's conversations that meet its figures apart from each other.
SALTS = 16

_ESCAPED = re.compile(r"\\\\|<\\|\[\\")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(MID) + r"(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """A backslash after each character that can begin a control string, and
    each backslash doubled: no control string survives, and it can be undone."""
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group()[0], text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """(formatted turn, where its text begins)."""
    head = OPEN + escape(role) + MID
    return head + escape(text) + CLOSE, len(head)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _conversations(turns: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    said = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return gathered.select("conv_id", said.alias("turns"))


def _key(turns: Column) -> Column:
    """Equal for equal lists of turns only (lengths go into the hash)."""
    parts = F.transform(turns, lambda x: F.concat(F.length(x["role"]).cast("string"), F.lit(":"), x["role"], F.length(x["text"]).cast("string"), F.lit(":"), x["text"]))
    return F.sha2(F.concat_ws("", parts), 256)


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One packed sequence of the conversations of a group."""
    nodes: list[tuple] = []  # start, end, position, parent, learnt text start and end, intervals
    children: list[dict] = []
    leaves: dict[int, list[str]] = {}
    roots: dict[tuple, int] = {}
    made: list[tuple[str, str]] = []
    for conv, turns in zip(pdf["conv_key"], pdf["turns"]):
        at, level = -1, roots
        for t in turns:
            said = (t["role"], t["text"])
            if said not in level:
                level[said] = len(made)
                made.append(said)
                children.append({})
            at = level[said]
            level = children[at]
        leaves.setdefault(at, []).append(conv)

    text: list[str] = []
    order: dict[int, int] = {}
    length = 0
    # (node, parent's place in the sequence, position, merged intervals of the ancestors)
    todo = [(n, -1, 0, ()) for n in reversed(roots.values())]
    while todo:
        n, parent, position, above = todo.pop()
        role, said = made[n]
        piece, head = format_turn(role, said)
        order[n] = len(nodes)
        start, end = length, length + len(piece)
        own = (*above[:-1], (above[-1][0], end)) if above and above[-1][1] == start else (*above, (start, end))
        learnt = (start + head, end - len(CLOSE)) if role == LEARNT else (start, start)
        nodes.append((start, end, position, parent, *learnt, own))
        text.append(piece)
        length = end
        todo += [(c, order[n], position + len(piece), own) for c in reversed(children[n].values())]
    return pd.DataFrame(
        {
            "pack": [f"{key[0]}-{key[1]}"],
            "text": ["".join(text)],
            "nodes": [[dict(zip(("start", "end", "position", "parent", "learn_start", "learn_end"), x[:6])) | {"attends": [{"start": a, "end": b} for a, b in x[6]]} for x in nodes]],
            "leaves": [[{"node": order.get(n, -1), "conv_key": c} for n, convs in leaves.items() for c in convs]],
        }
    )


_PACKED = (
    "pack string, text string,"
    "nodes array<struct<start:int,end:int,position:int,parent:int,learn_start:int,learn_end:int,attends:array<struct<start:int,end:int>>>>,"
    "leaves array<struct<node:int,conv_key:string>>"
)


def format_chats(spark: SparkSession, turns: DataFrame, pack: int = PACK) -> tuple[DataFrame, DataFrame]:
    """(packs, members) of ``turns(conv_id, turn, role, text)``.

    packs: text, nodes in depth-first order (interval of the text, first
    position id, parent, interval to learn, intervals to attend to) and leaves
    (node, conv_key). members: conv_id, conv_key.

    * Null roles and texts are empty; a null conv_id is a conversation of its
      own rows; a null turn comes first; rows that repeat a turn number are
      turns in the order of role and text.
    * A conversation is a training sequence and is held whole; a pack holds
      ``pack`` distinct conversations on average.
    * An empty table gives empty results; further columns are not read.
    """
    convs = stage(spark, _conversations(turns).withColumn("conv_key", _key(F.col("turns"))), "conversations")
    members = convs.select("conv_id", "conv_key")
    distinct = convs.groupBy("conv_key").agg(F.first("turns").alias("turns"))
    prefix = lambda n: _key(F.slice("turns", 1, n))
    distinct = stage(spark, distinct.select("conv_key", "turns", prefix(1).alias("tree"), prefix(2).alias("branch")), "distinct")

    # small trees are one pack; large ones are cut by branch, large branches by conversation
    trees = distinct.groupBy("tree").agg(F.ceil(F.count("*") / pack).alias("cuts")).filter("cuts > 1")
    branches = distinct.groupBy("tree", "branch").agg(F.ceil(F.count("*") / pack).alias("own")).filter("own > 1").drop("tree")
    # conversations of one tree meet its number of cuts in several tasks
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    cut = distinct.withColumn("salt", F.pmod(F.xxhash64("conv_key"), F.lit(SALTS)).cast("int"))
    cut = cut.join(trees.withColumn("salt", salts), ["tree", "salt"], "left").join(branches.withColumn("salt", salts), ["branch", "salt"], "left")
    part = F.when(F.col("own").isNotNull(), F.concat(F.col("branch"), F.lit("/"), F.pmod(F.xxhash64("conv_key"), "own"))).when(
        F.col("cuts").isNotNull(), F.pmod(F.xxhash64("branch"), "cuts").cast("string")
    )
    grouped = cut.withColumn("part", F.coalesce(part, F.lit("0"))).select("tree", "part", "conv_key", "turns")
    return stage(spark, grouped.groupBy("tree", "part").applyInPandas(_pack, _PACKED), "packs"), members


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each conversation back from its pack, by the intervals it attends to."""
    names = ["conv_key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for p in batch.to_pylist():
            for leaf in p["leaves"]:
                at, learnt, formatted = leaf["node"], [], ""
                if at >= 0:
                    formatted = "".join(p["text"][i["start"] : i["end"]] for i in p["nodes"][at]["attends"])
                while at >= 0:
                    node = p["nodes"][at]
                    learnt.append(unescape(p["text"][node["learn_start"] : node["learn_end"]]))
                    at = node["parent"]
                loss = "".join(reversed(learnt))
                said = read_turns(formatted)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((leaf["conv_key"], len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len(formatted)))
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def chat_digests(packs: DataFrame, members: DataFrame) -> DataFrame:
    read = packs.select("text", "nodes", "leaves").mapInArrow(
        _digests, "conv_key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return members.join(read, "conv_key").drop("conv_key")


def position_ids(node: dict) -> np.ndarray:
    """The position ids of a node of ``packs``, one a code point."""
    return np.arange(node["position"], node["position"] + node["end"] - node["start"])


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digests(*format_chats(spark, turns))


OP8_SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(role) + length(replace(role, '\', '')) * 0 + (length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')))
    + length(text) + (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', ''))) + {len(OPEN + MID + CLOSE)} as chars
  from c),
a as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    cast(sum(chars) as bigint) as formatted_chars
  from e group by conv_id)
select conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from a
"""
