"""Prefix trie of conversations, by the Euler-tour technique.

A node is a distinct sequence of leading turns. Sequences are told apart by two 64-bit sums (xor) over
the hashes of (place, turn), which are running aggregates, so a conversation is never gathered. A node is
named by its least member and its depth: the nodes of one least member form a downward path.

The tour enters a node, visits its children (first the one on the node's own path, then by least member) and
leaves it. Every node has an enter and an exit arc. Arcs that follow each other on one path are a run:
all enters of a path are one, and its exits fall into runs between the nodes at which other paths branch
off. The runs form a linked list, each with its number of arcs and the sums of what its enter arcs carry, and the list is
ranked by pointer jumping: in each round every run adds what its successor has gathered and takes over
its successor's successor, log2(runs) rounds of one equi-join each. Positions and prefix sums at an arc are those of its
run plus the arcs before it in the run; a subtree's sums are the prefix sum at its exit less that at its enter.

Order of turns: by turn, null first, then by hash of role and text. Null role or text is empty. Rows without
a conversation id are left out. Repeated rows are turns each. An empty table has no nodes, not even
a root. Texts are hashed at once and never travel, whatever their length. Different sequences with equal
128-bit hashes would be one node, which is not excluded but takes some 10**19 nodes to expect. Long
conversations and nodes with many children are dealt into blocks of their order; a node where many
conversations end has its ids sorted in blocks, and only the digest itself, which is sequential by definition, runs
over them in one task in a stream. Further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.expr import nsjoin
from platewise.llm.common import column, pick
from platewise.operators.order import order_bucket, row_order, running
from platewise.session import cut_lineage

BLOCK = 1024  # turns of one conversation summed by one window
IDS = 500  # ids of one piece of a digest's input


def ordered_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, place from 1, two hashes and the bytes of the text of every turn."""
    rows = pick(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select(F.col("conv").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), F.octet_length(text).cast("long").alias("size"))
    return cut_lineage(row_order(rows, ["conv"], "turn", ["t1", "t2"], "place")).select("conv", "place", "t1", "t2", "size")


def rebuilt(turns: DataFrame, groups: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """Turns of every rebuilt conversation, and the conversations with their length.

    Conversation c opens with the first h turns of conversation c - c % groups, all if it has fewer, none if
    it is absent, and goes on with its own turns after its first h; h = crc32(decimal c) % spread.
    """
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv").cast("string")) % spread
    convs = own.select("conv", "n", (F.col("conv") - F.col("conv") % groups).alias("base"), h.alias("h"))
    lengths = own.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lengths, "base", "left").withColumn("opens", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut_lineage(convs.select("conv", "base", "h", "opens", (F.col("opens") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    later = turns.join(convs.select("conv", "h", "opens"), "conv").where("place > h").withColumn("d", F.col("place") - F.col("h") + F.col("opens"))
    start = turns.where(F.col("place") < spread).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "opens"), "base").where("place <= opens").withColumn("d", F.col("place"))
    cols = ["conv", F.col("d").cast("long").alias("d"), "t1", "t2", "size"]
    return later.select(*cols).unionByName(start.select(*cols)), convs.select("conv", "length")


def with_prefix_keys(turns: DataFrame) -> DataFrame:
    """Adds the key (k1, k2) of the sequence up to each turn and that of the one before (p1, p2)."""
    rows = turns.select("conv", "d", "size", F.floor((F.col("d") - 1) / F.lit(BLOCK)).alias("b"), F.xxhash64("d", "t1", "t2").alias("z1"), F.xxhash64("t2", "d", "t1").alias("z2"))
    cells = rows.groupBy("conv", "b").agg(F.bit_xor("z1").alias("c1"), F.bit_xor("z2").alias("c2"))
    before = Window.partitionBy("conv").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("conv", "b", *[F.coalesce(F.bit_xor(f"c{i}").over(before), F.lit(0).cast("long")).alias(f"o{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv", "b").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.bit_xor(f"z{i}").over(upto).alias(f"x{i}") for i in (1, 2)]).join(cells, ["conv", "b"])
    keys = [F.col(f"x{i}").bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)]
    return rows.select("conv", "d", "size", *[k.alias(f"k{i}") for i, k in enumerate(keys, 1)], *[k.bitwiseXOR(F.col(f"z{i}")).alias(f"p{i}") for i, k in enumerate(keys, 1)])


def beside(df: DataFrame, keys: list[str], by: str, name: str, later: bool) -> DataFrame:
    """Adds the next (or the previous) value of ``by`` in its group, in blocks of the order."""
    rows = order_bucket(df, by, "_cell")
    shift, ends = (F.lead, F.min) if later else (F.lag, F.max)
    cells = rows.groupBy(*keys, "_cell").agg(ends(by).alias("_edge"))
    cells = cells.withColumn("_over", shift("_edge").over(Window.partitionBy(*keys).orderBy("_cell"))).drop("_edge")
    inside = rows.withColumn("_in", shift(by).over(Window.partitionBy(*keys, "_cell").orderBy(by)))
    return nsjoin(inside, cells, [*keys, "_cell"]).withColumn(name, F.coalesce("_in", "_over")).drop("_in", "_over", "_cell")


def node_table(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, d, parent path, members, bytes of the last text) and, per conversation, the key of its end."""
    keyed = cut_lineage(with_prefix_keys(turns))
    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv").alias("path"), F.count("*").alias("n_convs")).where("path is not null")
    nodes = keyed.groupBy("d", "k1", "k2").agg(F.min("conv").alias("path"), F.count("*").alias("n_convs"), F.min("size").alias("size"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = cut_lineage(nodes.unionByName(top.select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "path", "n_convs", zero.alias("size"), zero.alias("p1"), zero.alias("p2"))))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("path").alias("parent"))
    # the root's many children get its path as a single value
    first = nodes.where("d = 1").withColumn("parent", top.select("path").scalar())
    deeper = nodes.where("d > 1").join(above.where("d > 1"), ["d", "p1", "p2"])
    cols = ["d", "k1", "k2", "path", "parent", "n_convs", "size"]
    nodes = nodes.where("d = 0").withColumn("parent", F.lit(None).cast("long")).select(*cols).unionByName(first.select(*cols)).unionByName(deeper.select(*cols))
    ends = keyed.join(convs, "conv").where("d = length").select("conv", "d", "k1", "k2")
    ends = ends.unionByName(convs.where("length = 0").select("conv", zero.alias("d"), zero.alias("k1"), zero.alias("k2")))
    return cut_lineage(nodes), ends


def digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of the conversations that end at a node."""
    rows = order_bucket(ends, "conv", "cell")
    place = F.row_number().over(Window.partitionBy("d", "k1", "k2", "cell").orderBy("conv"))
    rows = rows.withColumn("piece", F.floor((place - 1) / F.lit(IDS)))
    pieces = rows.groupBy("d", "k1", "k2", "cell", "piece").agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition("d", "k1", "k2").sortWithinPartitions("d", "k1", "k2", "cell", "piece")

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            keys = zip(*[column(batch, c).to_pylist() for c in ("d", "k1", "k2")], strict=True)
            for key, ids in zip(keys, column(batch, "ids"), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            yield table(done)
        if now is not None:
            yield table([(*now, state.hexdigest())])

    def table(rows_: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, r, strict=True)) for r in rows_], schema=DIGEST)

    return pieces.select("d", "k1", "k2", "ids").mapInArrow(run, "d long, k1 long, k2 long, ends_sha256 string")


DIGEST = pa.schema([("d", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def tour_runs(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths, branches and the linked list of runs.

    A run is named (path, top): top -1 is the run of enter arcs, otherwise exits start at depth ``top`` and
    go up to depth ``low``. ``to_path``, ``to_top`` name its successor, null at the end of the tour.
    """
    paths = cut_lineage(nodes.groupBy("path").agg(
        F.min("d").alias("start"), F.max("d").alias("end"), F.min_by("parent", "d").alias("parent"), F.sum((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    ))
    side = paths.where("start > 0").select(F.col("parent"), (F.col("start") - 1).alias("at"), "path")
    following = beside(side, ["parent", "at"], "path", "next_path", True).select("path", "next_path")
    branches = cut_lineage(side.groupBy("parent", "at").agg(F.min("path").alias("first_child"), F.count("*").alias("n_side")).withColumnRenamed("parent", "path"))
    tops = paths.select("path", F.col("end").alias("top")).unionByName(branches.select("path", F.col("at").alias("top"))).distinct()
    exits = beside(tops, ["path"], "top", "branch", False)
    exits = exits.join(branches.select("path", F.col("at").alias("branch"), "first_child"), ["path", "branch"], "left")
    exits = exits.join(paths.select("path", "start", "parent"), "path").join(following, "path", "left")
    inside, over = F.col("branch").isNotNull(), F.col("next_path").isNotNull()
    exits = exits.select(
        "path", "top", F.when(inside, F.col("branch") + 1).otherwise(F.col("start")).alias("low"),
        F.when(inside, F.col("first_child")).when(over, F.col("next_path")).otherwise(F.col("parent")).alias("to_path"),
        F.when(inside | over, -1).when(F.col("start") > 0, F.col("start") - 1).cast("long").alias("to_top"),
    )
    zero = F.lit(0).cast("long")
    exits = exits.select("path", "top", "low", "to_path", "to_top", (F.col("top") - F.col("low") + 1).alias("arcs"), zero.alias("leaves"), zero.alias("saved"))
    enters = paths.join(branches.select("path", F.col("at").alias("end"), "first_child"), ["path", "end"], "left")
    leaf = F.col("first_child").isNull()
    enters = enters.select(
        "path", F.lit(-1).cast("long").alias("top"), F.lit(None).cast("long").alias("low"), F.coalesce("first_child", "path").alias("to_path"), F.when(leaf, F.col("end")).otherwise(-1).alias("to_top"),
        (F.col("end") - F.col("start") + 1).alias("arcs"), leaf.cast("long").alias("leaves"), "saved",
    )
    return paths, branches, cut_lineage(enters.unionByName(exits))


SUMS = ["arcs", "leaves", "saved"]


def ranked(runs: DataFrame) -> DataFrame:
    """What lies before each run on the tour, by pointer jumping: ``before_<sum>``."""
    n = runs.count()
    jump = runs.select("path", "top", "to_path", "to_top", *SUMS)
    for _ in range(math.ceil(math.log2(n)) if n > 1 else 0):
        ahead = jump.select(F.col("path").alias("to_path"), F.col("top").alias("to_top"), F.col("to_path").alias("on_path"), F.col("to_top").alias("on_top"), *[F.col(c).alias(f"on_{c}") for c in SUMS])
        # a run at the end keeps its sums
        jump = cut_lineage(jump.join(ahead, ["to_path", "to_top"], "left").select(
            "path", "top", F.col("on_path").alias("to_path"), F.col("on_top").alias("to_top"), *[(F.col(c) + F.coalesce(f"on_{c}", F.lit(0))).alias(c) for c in SUMS],
        ))
    total = jump.agg(*[F.max(c).alias(c) for c in SUMS]).first()
    # every run has now summed up itself and all that follows; the sums are not negative, so the first run has the largest
    after = jump.select("path", "top", *[(F.lit(total[c]).cast("long") - F.col(c)).alias(f"before_{c}") for c in SUMS])
    return runs.join(after, ["path", "top"])


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", groups: int = 5, spread: int = 9) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with its arcs' places on the tour.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter_at, exit_at.
    """
    turns, convs = rebuilt(ordered_turns(df, conv_col, turn_col, role_col, text_col), groups, spread)
    nodes, ends = node_table(turns, convs)
    paths, branches, runs = tour_runs(nodes)
    tour = cut_lineage(ranked(runs))
    entered = tour.where("top = -1").select("path", F.col("before_arcs").alias("e_arcs"), F.col("before_leaves").alias("e_leaves"), F.col("before_saved").alias("e_saved"))
    # each exit run stands for the nodes low..top of its path; long ones are opened in blocks
    opened = tour.where("top >= 0").select("path", "top", "low", "before_arcs", "before_leaves", "before_saved", F.explode(F.sequence("low", "top", F.lit(BLOCK).cast("long"))).alias("from"))
    opened = opened.select("path", "top", "before_arcs", "before_leaves", "before_saved", F.explode(F.sequence("from", F.least(F.col("from") + (BLOCK - 1), "top"))).alias("d"))
    summed = running(nodes.withColumn("_b", F.floor(F.col("d") / F.lit(BLOCK))), ["path"], "_b", [F.col("d")], {"own": (F.col("n_convs") - 1) * F.col("size")}).drop("_b")
    out = summed.join(opened, ["path", "d"]).join(paths.select("path", "start", "end"), "path").join(entered, "path")
    out = out.join(branches.select("path", F.col("at").alias("d"), "n_side"), ["path", "d"], "left").join(digests(cut_lineage(ends)), ["d", "k1", "k2"], "left")
    return out.select(
        F.col("path").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
        (F.coalesce("n_side", F.lit(0)) + (F.col("d") < F.col("end")).cast("long")).alias("n_children"),
        (F.col("before_leaves") - F.col("e_leaves")).alias("n_leaves"),
        (F.col("before_saved") - F.col("e_saved") - F.col("before_own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        (F.col("e_arcs") + F.col("d") - F.col("start")).alias("enter_at"), (F.col("before_arcs") + F.col("top") - F.col("d")).alias("exit_at"),
    )
