"""K-d tree sharding of documents by byte size, with DataFrame operations only.

A node of the tree holds some of the documents and a number of shards. It is
split along its widest metadata dimension (language, source, characters) at the
weighted median: the point of the dimension's order with the sizes in
proportion to the two sides' shards. A dimension's axis is the share of all
bytes: every value lies in the middle of the bytes that have it, languages and
sources from the most bytes to the least, lengths from short to long, and a
node's width is the standard deviation of its bytes on that axis. The median is
found exactly enough by counting: each pass sums bytes over at most ``BINS``
slices of the interval that still holds the median, for all nodes of a level at
once, so the driver sees a few numbers a node and no document. Every order ends
in a hash of the row, therefore equal metadata (one source with a third of all
rows) and equal rows split as well.
"""

from __future__ import annotations

import json
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, checkpointed, dropped, stored

#: Slices of an interval in one counting pass, at most, and of all intervals of a level together.
BINS, BINS_A_PASS = 8_192, 262_144
#: A median may be off by this share of its node's bytes.
TOLERANCE = 0.0002
#: Values that an axis tells apart: hash values of a language or source, steps of a length's logarithm.
VALUES, STEPS_A_DOUBLING = 4_096, 128
#: Bits of the row's hash below a value's code in an order, of them for rows that are alike, and of the code.
HASH_BITS, ALIKE_BITS, CODE_BITS = 40, 12, 22
#: Slots are counted in groups of about so many rows, in at most so many groups a shard.
GROUP_ROWS, MOST_GROUPS = 2_000, 65_536
#: Levels between checkpoints of the nodes.
LEVELS = 4
DIMENSIONS = ("lang", "source", "length")


def _category(name: str) -> Column:
    """A value number for a metadata string; null is one more string."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("\x00")).cast("binary")) % F.lit(VALUES)


def codes_of(bytes_of: dict[int, int], by_size: bool) -> list[int]:
    """The code of every value number: the middle of its bytes on the axis, in parts of 2**CODE_BITS."""
    order = sorted(bytes_of, key=lambda v: (-bytes_of[v], v)) if by_size else sorted(bytes_of)
    codes, before, total = [0] * VALUES, 0, max(1, sum(bytes_of.values()))
    for value in order:
        codes[value] = int((2 * before + bytes_of[value]) * (2**CODE_BITS - 1) // (2 * total))
        before += bytes_of[value]
    return codes


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as one literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def kd_shards(
    docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Return ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row.

    ``shards`` fixes the number of leaves; with None it is the least number
    whose mean stays within ``target_bytes``. ``size`` is the UTF-8 length plus
    1, so a null text counts 1 and has the crc32 of no bytes. The law is
    ``bytes``: shard sizes differ by little more than one document, however long
    the longest. Slots are gapless from 0 in a shard; ``grown_shard`` is null.
    Null ids and repeated rows, however many, are placed like any row; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    alike = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**ALIKE_BITS))
    tie = F.shiftleft(F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.crc32(body)), F.lit(2 ** (HASH_BITS - ALIKE_BITS))), ALIKE_BITS) + alike
    steps = F.floor(F.lit(STEPS_A_DOUBLING) * F.log2(F.lit(1) + F.length(F.coalesce(F.col(text), F.lit(""))))).cast("long")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        tie.alias("tie"),
        _category(lang).alias("v_lang"),
        _category(source).alias("v_source"),
        steps.alias("v_length"),
    )
    sizes = stored(rows, "sizes")
    orders = []
    for d in DIMENSIONS:
        # at most VALUES numbers, whatever the table
        bytes_of = {r[0]: r[1] for r in sizes.groupBy(f"v_{d}").agg(F.sum("size")).collect()}
        codes = F.from_json(F.lit(json.dumps(codes_of(bytes_of, d != "length"))), "array<long>")
        orders.append(F.shiftleft(F.get(codes, F.col(f"v_{d}").cast("int")), HASH_BITS) + F.col("tie"))
    rows = stored(sizes.select("doc_id", "size", "text_crc32", "tie", F.array(*orders).alias("orders")), "orders")
    dropped(sizes)
    spans = []
    for d in range(len(DIMENSIONS)):
        order, at = F.col("orders")[d], F.shiftright(F.col("orders")[d], HASH_BITS) / F.lit(2.0**CODE_BITS)
        spans += [F.min(order).alias(f"lo{d}"), F.max(order).alias(f"hi{d}"), F.sum(F.col("size") * at).alias(f"one{d}"), F.sum(F.col("size") * at * at).alias(f"two{d}")]
    whole = rows.agg(F.sum("size").alias("bytes")).first()
    if shards is None:
        shards = max(1, ceil((whole.bytes or 0) / target_bytes))

    # a node is its first shard; ``leaves`` has the shards of each node that is still split
    placed = rows.withColumn("node", F.lit(0))
    leaves = {0: shards} if whole.bytes else {}
    level = 0
    while leaves := {k: n for k, n in leaves.items() if n > 1}:
        facts = placed.where(F.col("node").isin(list(leaves))) if len(leaves) <= 1000 else placed
        facts = facts.groupBy("node").agg(F.sum("size").alias("bytes"), *spans).collect()
        nodes = {}
        for r in facts:
            if r.node in leaves:
                widths = [sqrt(max(0.0, r[f"two{d}"] / r.bytes - (r[f"one{d}"] / r.bytes) ** 2)) for d in range(len(DIMENSIONS))]
                dim = max(range(len(DIMENSIONS)), key=lambda d: (round(widths[d], 9), d))
                goal = r.bytes * (leaves[r.node] // 2) / leaves[r.node]
                nodes[r.node] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"], "below": 0, "goal": goal, "slack": r.bytes * TOLERANCE, "cut": None}
        while open_nodes := {k: v for k, v in nodes.items() if v["cut"] is None}:
            bins_each = max(64, min(BINS, BINS_A_PASS // len(open_nodes)))
            slices = [(k, v["dim"], v["lo"], v["hi"], max(1, ceil((v["hi"] - v["lo"] + 1) / bins_each))) for k, v in open_nodes.items()]
            edges = _table(spark, slices, "node int, dim int, lo long, hi long, step long")
            key = F.element_at("orders", F.col("dim") + 1)
            near = placed.join(_bounded(edges, len(slices)), "node").withColumn("key", key).where("key between lo and hi")
            bins = near.groupBy("node", F.expr("(key - lo) div step").alias("slice")).agg(
                F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last")
            )
            bins = {(r.node, r.slice): r for r in bins.collect()}
            by_node = {k: [] for k in open_nodes}
            for n, i in sorted(bins):
                by_node[n].append(i)
            for k, v in open_nodes.items():
                for at in by_node[k]:
                    found = bins[k, at]
                    if v["below"] + found.bytes >= v["goal"]:
                        break
                    v["below"] += found.bytes
                if found.first == found.last or found.bytes <= v["slack"]:
                    # the slice goes to the side that leaves less error; rows up to the cut go left
                    v["cut"] = found.last if v["below"] + found.bytes - v["goal"] <= v["goal"] - v["below"] else found.first - 1
                else:
                    v["lo"], v["hi"] = found.first, found.last
        cuts = _table(
            spark, [(k, v["dim"], v["cut"], k + leaves[k] // 2) for k, v in nodes.items()], "node int, dim int, cut long, right int"
        )
        right = F.element_at("orders", F.col("dim") + 1) > F.col("cut")
        placed = placed.join(_bounded(cuts, len(nodes)), "node", "left").select(
            *rows.columns, F.when(right, F.col("right")).otherwise(F.col("node")).alias("node")
        )
        # a side without rows has no facts and is not split again
        leaves = {**{k: leaves[k] // 2 for k in nodes}, **{k + leaves[k] // 2: leaves[k] - leaves[k] // 2 for k in nodes}}
        level += 1
        if level % LEVELS == 0:
            placed = checkpointed(placed)
    return _slots(placed)


def _bounded(nodes: DataFrame, n: int) -> DataFrame:
    return F.broadcast(nodes) if n <= BROADCAST_ROWS else nodes


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard without bringing a shard to one task."""
    rows = placed.count()
    groups = min(MOST_GROUPS, max(1, rows // GROUP_ROWS))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("tie", F.lit(1)), F.lit(groups)).cast("int"))
    before = Window.partitionBy("node").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("node", "salt").agg(F.count("*").alias("n")).select("node", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("node", "salt").orderBy("doc_id", "text_crc32", "tie")
    return (
        salted.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["node", "salt"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("node").cast("int").alias("shard"),
            (F.col("at") + F.col("before")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
