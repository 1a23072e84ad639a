"""The trie of all conversations' prefixes: who shares which turns, and what caching a shared prefix saves.

A node is a distinct sequence of a conversation's first turns (role, text); its members are the conversations that start with it.

Method. Preorder intervals. The distinct conversations are ranked in lexicographic order (of their turns' hashes), so the members of a
node are neighbours. A node is known by its first and last member's rank: it comes first in the interval of its subtree, which ends with the
last turn of the last member. Nodes sorted by (first rank, depth) are in preorder; running sums over that order (taken range by range,
:mod:`emberlane.llm.running`) give a subtree's leaves and savings as the difference between its end and its start.

Long conversations. Conversations are cut into blocks of ``width`` turns. Distinct blocks are ranked, the ranks become the turns of
a conversation ``width`` times shorter, and so on until one block is left. So no row holds more than ``width`` turns, even if one conversation
has a third of all turns; its turns are numbered by running sums, too.

Size. After the first step rows hold a 16-byte hash in place of a turn's text. A node that many conversations end at gets its ids in
chunks of 64 KB, which one task hashes as a stream, as SHA-256 asks. Hot nodes are combined before the shuffle; joins by a hot parent
are left to the skew handling of Spark's adaptive joins.

Edge cases. Null role or text is the empty string; null turns come first; equal turns of a conversation are ordered by md5 of role and text, and
repeated rows are turns of their own. Rows without ``conv_id`` belong to no conversation. Ids below zero follow SQL's remainder (-21 % 20
is -1). An empty table has no node. Other columns are not read. Texts of any length are read whole. Turns and prefixes are told apart by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.llm.running import running_sums
from emberlane.llm.scratch import materialize

_NONE = hashlib.sha256().hexdigest()
_CHUNK = 1 << 16


def _md5(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1)``, sym, words`` of each turn: its place, the hash of role and text, and its text's words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sym = _md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), sym.alias("sym"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    rows = materialize(rows.where("conv_id IS NOT NULL"), "turns")
    return running_sums(rows, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("sym")], {"pos": "one"}, "ordered", "conv_id").select("conv_id", "pos", "sym", "words")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that take their first ``h`` turns from the first one of their family.

    ``h`` is the CRC-32 of the decimal id modulo ``heads``; the family's first has the id without the remainder by ``family``. A row
    for each turn, with its new ``pos``; a conversation that is left without turns has one row with null ``pos``.
    """
    h = F.expr(f"crc32(cast(cast(conv_id AS STRING) AS BINARY)) % {heads}")
    head = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "sym", "words"))).alias("head"))
    convs = turns.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(head, "base", "left")
    convs = materialize(convs.select("conv_id", "h", F.expr("slice(coalesce(head, array()), 1, cast(h AS INT))").alias("lead")), "leads")
    short = convs.where("size(lead) < h").select("conv_id", (F.col("h") - F.size("lead")).alias("less"))
    own = turns.where(F.col("pos") > h).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "sym", "words")
    led = convs.select("conv_id", F.explode("lead").alias("t")).select("conv_id", "t.pos", "t.sym", "t.words")
    every = convs.select("conv_id", *[F.lit(None).cast(k).alias(c) for c, k in (("pos", "long"), ("sym", "binary"), ("words", "long"))])
    return own.unionByName(led).unionByName(every)


def _levels(rows: DataFrame, width: int, level: int = 0) -> tuple[DataFrame, DataFrame]:
    """Of ``conv_id, pos, sym, words``: blocks with the ids of their prefixes, and ``conv_id, rank, last`` in lexicographic order.

    Blocks are ``conv_id, q, items, ids, before``: ``ids`` name the prefixes that end at the block's items, ``before`` the one before it.
    """
    cut = rows.groupBy("conv_id", F.expr(f"(pos - 1) div {width}").alias("q")).agg(F.array_sort(F.collect_list(F.struct("pos", "sym", "words"))).alias("items"))
    start = F.struct(F.lit(hashlib.md5(f"level {level}".encode()).digest()).alias("last"), F.expr("cast(array() AS array<binary>)").alias("ids"))

    def step(state: Column, item: Column) -> Column:
        now = _md5(state["last"], item["sym"])
        return F.struct(now.alias("last"), F.concat(state["ids"], F.array(now)).alias("ids"))

    blocks = materialize(cut.withColumn("ids", F.aggregate("items", start, step)["ids"]), f"blocks{level}")
    name = F.element_at("ids", -1)
    kinds = blocks.select(name.alias("block"), F.col("items.sym").alias("syms")).groupBy("block").agg(F.any_value("syms").alias("syms"))
    ranks = materialize(kinds.repartitionByRange("syms").sortWithinPartitions("syms").select("block", F.monotonically_increasing_id().alias("rank")), f"ranks{level}")
    placed = blocks.select("conv_id", "q", name.alias("block")).join(ranks, "block")
    if not blocks.where("q > 0").limit(1).count():
        return blocks.withColumn("before", F.lit(b"")), placed.select("conv_id", "rank", F.col("block").alias("last"))
    above, order = _levels(placed.select("conv_id", (F.col("q") + 1).alias("pos"), F.unhex(F.lpad(F.hex("rank"), 16, "0")).alias("sym"), F.lit(0).cast("long").alias("words")), width, level + 1)
    ids = above.select("conv_id", F.explode(F.arrays_zip("items", "ids")).alias("z")).select("conv_id", F.col("z.items.pos").alias("q"), F.col("z.ids").alias("id"))
    blocks = blocks.join(ids.withColumnRenamed("id", "before"), ["conv_id", "q"], "left").join(ids.select("conv_id", (F.col("q") - 1).alias("q"), F.col("id").alias("upto")), ["conv_id", "q"], "left")
    # a full block's end goes by the name that the level above has for it, as does the start of the next
    whole = F.size("ids") == width
    ids = F.when(whole, F.concat(F.slice("ids", 1, F.size("ids") - 1), F.array("upto"))).otherwise(F.col("ids"))
    inner = F.when(F.length("before") > 0, F.transform("ids", lambda x: _md5(F.col("before"), x))).otherwise(F.col("ids"))
    blocks = blocks.withColumn("before", F.coalesce("before", F.lit(b""))).withColumn("ids", inner).withColumn("ids", ids).drop("upto")
    blocks = materialize(blocks, f"named{level}")
    ends = blocks.groupBy("conv_id").agg(F.max_by(F.element_at("ids", -1), "q").alias("last"))
    return blocks, order.select("conv_id", "rank").join(ends, "conv_id")


def _digests(ends: DataFrame) -> DataFrame:
    """``id, ends_sha256`` of ``id, conv_id``: the hash of each node's ids, in order and joined by commas."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, str]] = []
        at, first, ids, size = None, 0, [], 0
        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (node != at or size > _CHUNK):
                    out.append((at, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    at, first = node, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield _batch(out, ("id", "first", "chunk"), (pa.binary(), pa.int64(), pa.string()))
                out = []
        if ids:
            yield _batch([(at, first, ",".join(ids))], ("id", "first", "chunk"), (pa.binary(), pa.int64(), pa.string()))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for node, chunk in zip(batch.column(0).to_pylist(), batch.column(2)):
                if state is None or node != at:
                    if state is not None:
                        out.append((at, state.hexdigest()))
                    at, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(chunk.as_buffer())
            if out:
                yield _batch(out, ("id", "ends_sha256"), (pa.binary(), pa.string()))
        if state is not None:
            yield _batch([(at, state.hexdigest())], ("id", "ends_sha256"), (pa.binary(), pa.string()))

    chunks = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(gather, "id binary, first long, chunk string")
    return chunks.repartition("id").sortWithinPartitions("id", "first").mapInArrow(stream, "id binary, ends_sha256 string")


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def prefix_trie(turns: DataFrame, *, width: int = 256) -> DataFrame:
    """Nodes of the trie of ``conv_id, pos, sym, words`` (a row with null ``pos`` names a conversation that may have no turn).

    ``conv_id`` (the smallest member)``, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder,
    subtree_end``: ``preorder`` numbers the nodes from 1, and a node's subtree is the nodes from its own number to ``subtree_end``.
    """
    turns = materialize(turns.select("conv_id", "pos", "sym", "words"), "rebuilt")
    convs = turns.select("conv_id").distinct()
    blocks, order = _levels(turns.where("pos IS NOT NULL"), width)
    order = materialize(order.select("conv_id", "rank", "last"), "order")
    # of equal conversations the first stands for all
    stands = order.groupBy("rank").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    each = F.expr("transform(ids, (x, i) -> struct(x AS id, if(i = 0, before, ids[i - 1]) AS parent, items[i].pos AS depth, items[i].words AS words))")
    on_path = blocks.join(stands, "conv_id").select("conv_id", "rank", "n", F.explode(each).alias("t")).select("conv_id", "rank", "n", "t.*")
    nodes = on_path.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), F.sum("n").alias("n_convs"), F.any_value("words").alias("words"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))
    last = order.agg(F.max("rank").alias("last_rank"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").crossJoin(last)  # a row each
    root = root.select(F.lit(b"").alias("id"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("first_rank"), F.coalesce("last_rank", F.lit(-1)).alias("last_rank"))
    nodes = materialize(nodes.unionByName(root), "nodes")

    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(parents, "parent", "left").drop("parent")
    weighed = nodes.select("*", F.lit(1).cast("long").alias("one"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    summed = running_sums(weighed, [F.col("first_rank"), F.col("depth")], {"preorder": "one", "leaves": "leaf", "savings": "saved"}, "preorder")
    ends = summed.groupBy(F.col("first_rank").alias("last_rank")).agg(F.max("preorder").alias("subtree_end"), F.max("leaves").alias("end_leaves"), F.max("savings").alias("end_savings"))
    out = summed.join(ends, "last_rank")

    turnless = convs.join(order, "conv_id", "left_anti").select(F.lit(b"").alias("id"), "conv_id")
    digests = _digests(order.select(F.col("last").alias("id"), "conv_id").unionByName(turnless))
    out = out.join(digests, "id", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("end_savings") - F.col("savings") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"), "preorder", "subtree_end",
    )
