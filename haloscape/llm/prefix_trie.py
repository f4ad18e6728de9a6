"""Conversation prefix trie, family first.

Conversations that branch off a common one share their first turns.  Each conversation has a base (another conversation, or itself) and a number of turns taken
from it; it is rebuilt as those turns and its own after as many.  A node is a distinct sequence of first turns (role and text) of rebuilt conversations; the root is the empty one.

1. A turn becomes 128 bits of its role and text and a count of words; no text is shuffled.  Conversations and their bases are cogrouped by the base's id, rebuilt, and put
   into the family's small trie, whose nodes are named by the hash of their turns' hashes, one after the other.
2. Only these combined nodes are shuffled: their members, smallest member and whether they have children are merged by name.
3. What a node's whole subtree holds needs each global node once, and how deep the trie is must not matter.  So a node belongs to the family of its smallest
   member, and what was merged goes back to the families; each sums its own trie from the leaves up, with what belongs to it, and those sums are added by name.
   A family holds all ancestors of its nodes, so the sums are exact after one shuffle, whatever the depth.
4. The ids that end at a node are packed in blocks of ``BLOCK`` ids, and each node's blocks are hashed in order, one at a time.

Nodes of many families (the root, common openings) are few rows after partial aggregation; where merged values go back, nodes that ``1 / HOT`` of all
family nodes or more share (so ``HOT`` at most) are sent to all tasks, and the others are joined; nodes of one family need neither.  A task holds one family: 16 bytes and
some numbers for each turn, never texts.

Results: a row for each node.  Null roles and texts are empty; turns are in order of ``turn``, nulls first, equal ones by their hash.  Rows without a conversation's id
are in no conversation and are left out.  Repeated rows are repeated turns.  An absent base gives no turns; a conversation left without turns is a member of the root.  Other columns
are ignored.  No conversations: no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, white_words

BLOCK = 4096
HOT = 10_000
ROOT = bytes(16)
TURNS = "base long, conv_id long, taken long, turn long, digest binary, words long"
NODES = "base long, at int, parent int, depth long, node binary, words long, n long, conv_id long, inner boolean, ends array<long>"
SUMS = "node binary, member_words long, own_words long, own_leaves long, own_children long, depth long, conv_id long, parent_conv_id long, n_convs long"


def turns(conversations: DataFrame, base: Column, taken: Column) -> DataFrame:
    """A row for each turn, without its text."""
    role, text = F.coalesce(column("role"), F.lit("")), F.coalesce(column("text"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    found = conversations.where(column("conv_id").isNotNull())
    return found.select(
        base.cast("bigint").alias("base"), column("conv_id").cast("bigint").alias("conv_id"), taken.cast("bigint").alias("taken"),
        column("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.size(white_words(text)).cast("bigint").alias("words"),
    )


def by_conversation(table: pa.Table) -> dict[int, tuple[int, list[tuple[bytes, int]]]]:
    """Of each conversation, in ascending order: the number of turns to take, and its turns in order."""
    found: dict[int, tuple[int, list]] = {}
    rows = zip(*(table.column(c).to_pylist() for c in ("conv_id", "taken", "turn", "digest", "words")), strict=True)
    for conv, taken, turn, digest, words in rows:
        found.setdefault(conv, (taken, []))[1].append((turn is not None, turn or 0, digest, words))
    return {c: (taken, [x[2:] for x in sorted(said)]) for c, (taken, said) in sorted(found.items())}


def family(own: pa.Table, bases: pa.Table) -> pa.Table:
    """The trie of the conversations of one base; a parent stands before its children."""
    base = by_conversation(bases)
    first = next(iter(base.values()))[1] if base else []
    members = sorted((by_conversation(own) | base).items())
    key = (own if own.num_rows else bases).column("base")[0].as_py()
    known: dict[tuple[int, bytes], int] = {}
    at = {"parent": [-1], "depth": [0], "node": [ROOT], "words": [0], "n": [0], "conv_id": [members[0][0]], "inner": [False], "ends": [[]]}
    for conv, (taken, said) in members:
        here = 0
        at["n"][0] += 1
        for digest, words in [*first[:taken], *said[taken:]]:
            below = known.get((here, digest))
            if below is None:
                below = known[here, digest] = len(at["n"])
                at["inner"][here] = True
                for name, value in (("parent", here), ("depth", at["depth"][here] + 1), ("node", hashlib.blake2b(at["node"][here] + digest, digest_size=16).digest())):
                    at[name].append(value)
                for name, value in (("words", words), ("n", 0), ("conv_id", conv), ("inner", False), ("ends", [])):
                    at[name].append(value)
            here = below
            at["n"][here] += 1
        at["ends"][here].append(conv)
    kinds = {"parent": pa.int32(), "node": pa.binary(), "inner": pa.bool_(), "ends": pa.list_(pa.int64())}
    size = len(at["n"])
    return pa.table({"base": pa.array([key] * size, pa.int64()), "at": pa.array(range(size), pa.int32())} | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in at.items()})


def family_nodes(said: DataFrame) -> DataFrame:
    """The families' tries.  A base is a conversation that is its own base."""
    is_base = F.coalesce(F.col("base") == F.col("conv_id"), F.lit(False))
    own = said.withColumn("base", F.coalesce("base", "conv_id"))
    return own.where(~is_base).groupBy("base").cogroup(own.where(is_base).groupBy("base")).applyInArrow(family, NODES)


def with_merged(nodes: DataFrame) -> DataFrame:
    """The families' nodes with ``all_n``, ``all_conv`` and ``all_inner``: members, smallest member and whether there are children, over all families."""
    merged = nodes.groupBy("node").agg(F.sum("n").alias("all_n"), F.min("conv_id").alias("all_conv"), F.max("inner").alias("all_inner"), F.count("*").alias("families"))
    shared = materialize(merged.where("families > 1"), "shared")
    hot = F.col("families") * HOT > nodes.count()
    few, rest = F.broadcast(shared.where(hot).drop("families")), shared.where(~hot).drop("families")
    joined = nodes.join(few, "node").unionByName(nodes.join(few.select("node"), "node", "left_anti").join(rest, "node", "left"))
    return joined.withColumns({"all_n": F.coalesce("all_n", "n"), "all_conv": F.coalesce("all_conv", "conv_id"), "all_inner": F.coalesce("all_inner", "inner")})


def family_sums(table: pa.Table) -> pa.Table:
    """What the family adds to the subtrees of its nodes, and the merged values of the nodes that belong to it."""
    table = table.sort_by("at")
    parent, words, n, conv, all_n, all_conv, depth = (table.column(c).to_numpy() for c in ("parent", "words", "n", "conv_id", "all_n", "all_conv", "depth"))
    inner = table.column("all_inner").to_numpy()
    own = conv == all_conv
    below = np.stack([n * words, own * words, own & ~inner]).astype(np.int64)
    for k in range(len(parent) - 1, 0, -1):  # children stand after their parent
        below[:, parent[k]] += below[:, k]
    children = np.bincount(parent[1:][own[1:]], minlength=len(parent))
    lacks = ~own
    return pa.table({
        "node": table.column("node"), "member_words": below[0], "own_words": below[1], "own_leaves": below[2], "own_children": children.astype(np.int64),
        "depth": pa.array(depth, mask=lacks), "conv_id": pa.array(all_conv, mask=lacks), "parent_conv_id": pa.array(all_conv[parent], mask=lacks | (parent < 0)), "n_convs": pa.array(all_n, mask=lacks),
    })


def ends(nodes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end."""
    ids = nodes.select("node", F.explode("ends").alias("id"))
    packed = ids.groupBy("node", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, so_far = None, None
        for batch in batches:
            done = []
            for node, said in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == held:
                    so_far.update(b"," + said.encode())
                else:
                    if held is not None:
                        done.append((held, so_far.hexdigest()))
                    held, so_far = node, hashlib.sha256(said.encode())
            yield packed_rows(done)
        if held is not None:
            yield packed_rows([(held, so_far.hexdigest())])

    return packed.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(digests, "node binary, ends_sha256 string")


def packed_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])


def prefix_trie(conversations: DataFrame, base: Column | None = None, taken: Column | None = None) -> DataFrame:
    """The nodes: ``node`` (its name), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (words that members beyond the first needn't repeat, over the subtree) and ``ends_sha256``.

    ``base`` and ``taken`` (constant for a conversation, of its id) say where a conversation branches off; without them each one is whole."""
    base = column("conv_id") if base is None else base
    nodes = materialize(family_nodes(turns(conversations, base, F.lit(0) if taken is None else taken)), "nodes")
    summed = with_merged(nodes).drop("ends").groupBy("base").applyInArrow(family_sums, SUMS)
    total = summed.groupBy("node").agg(
        F.sum("member_words").alias("member_words"), F.sum("own_words").alias("own_words"), F.sum("own_leaves").alias("n_leaves"), F.sum("own_children").alias("n_children"),
        *[F.max(c).alias(c) for c in ("depth", "conv_id", "parent_conv_id", "n_convs")],
    )
    out = total.join(ends(nodes), "node", "left")
    return out.select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("member_words") - F.col("own_words")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
