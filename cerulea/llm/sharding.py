"""Sharding by fixed virtual slots.

Every row is hashed by id and text into one of ``n_slots`` virtual slots, for ever. A small versioned map says which shard holds which slot. Bytes are
aggregated per slot, and only the map is edited to even out the shards or to add one: rows move with their slots. A slot that repeated rows fill beyond four times
the mean is held in several parts, each with an entry of its own in the map.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cerulea.llm.common import read_table, stored
from cerulea.sinks.shared import file_system, shared_folder

N_SLOTS = 4096
ROW_BYTES = 16
HOT = 4
TOLERANCE = 0.001
MAP = "n_slots int, n_shards int, vslot int, part int, shard int, first long"
MIX_RANGE = 1024


def slot_of(col, crc, n_slots: int = N_SLOTS):
    """The virtual slot of a row: the first 32 bits of the MD5 of its id and its text's checksum, modulo ``n_slots``, so rows of one id, or of none, are spread by their texts."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(col.cast("string"), F.lit("")), crc.cast("string")).cast("binary")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n_slots)).cast("int")


def measured(docs: DataFrame, n_slots: int = N_SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) and ``keep``: what the slots are filled with. size = UTF-8 bytes of the text (null: none) + 16."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = F.octet_length(text).cast("long") + ROW_BYTES, F.crc32(text.cast("binary"))
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), *keep).withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), n_slots))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Rows and bytes per virtual slot: at most ``n_slots`` rows, summed in each task before the shuffle."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def with_parts(rows: DataFrame, n_slots: int, *spread: str) -> tuple[DataFrame, dict]:
    """``rows`` with the column part, and {(vslot, part): (bytes, rows)}, whose size is fixed at 2 * ``n_slots``.

    part: 0, or for slots of several rows and more than ``HOT`` times the mean, one of so many parts that each has about the mean, by hash of ``spread``, columns
    that tell repeated rows apart.
    """
    held = {(r["vslot"], 0): (r["bytes"], r["rows"]) for r in slot_bytes(rows).collect()}
    mean = max(1, -(-sum(b for b, _ in held.values()) // n_slots))
    hot = [(s, min(n, -(-b // mean))) for (s, _), (b, n) in held.items() if b > HOT * mean and n > 1]
    if not hot:
        return rows.withColumn("part", F.lit(0)), held
    parts = rows.sparkSession.createDataFrame(hot, "vslot int, parts int")  # n_slots / HOT rows at most
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("parts"))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(parts), "vslot", "left").withColumn("part", part).drop("parts")
    split = rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return rows, {(r["vslot"], r["part"]): (r["bytes"], r["rows"]) for r in split}


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    """A first map: slot s in shard s modulo the count, whatever the slots hold."""
    return [s % n_shards for s in range(n_slots)]


def rebalanced(current: list[int], size: dict[int, int], n_shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map edited until bytes per shard are near equal, moving as few slots as it can.

    Again and again the heaviest shard hands the lightest the slot, or swaps with it the pair of slots, that comes nearest to halving their gap. It ends
    when the gap is within ``tolerance`` of the mean or no move narrows it. Works on the map alone (a fixed number of slots), never on rows.
    """
    out = list(current)
    held: dict[int, list[tuple[int, int]]] = {k: [] for k in range(n_shards)}
    for s, k in enumerate(out):
        if size.get(s, 0):
            insort(held[k], (size[s], s))
    loads = {k: sum(b for b, _ in v) for k, v in held.items()}
    mean = sum(loads.values()) / n_shards
    while True:
        heavy, light = max(loads, key=lambda k: (loads[k], -k)), min(loads, key=lambda k: (loads[k], k))
        gap = loads[heavy] - loads[light]
        if gap <= tolerance * mean:
            return out
        best = None
        for back in [(0, None), *held[light]]:  # a slot for nothing, or for one of the lightest shard's
            i = bisect_left(held[heavy], (back[0] + gap // 2, -1))
            for x in held[heavy][max(0, i - 1) : i + 1]:
                if 0 < x[0] - back[0] < gap and (best is None or abs(2 * (x[0] - back[0]) - gap) < best[0]):
                    best = (abs(2 * (x[0] - back[0]) - gap), x, back)
        if best is None:
            return out
        _, x, back = best
        for move, of, to in ((x, heavy, light), (back, light, heavy)):
            if move[1] is not None:
                held[of].remove(move)
                insort(held[to], move)
                out[move[1]] = to
                loads[of] -= move[0]
                loads[to] += move[0]


def grown(current: list[int], size: dict[int, int], n_shards: int) -> list[int]:
    """The map with one more shard: slots move only into the new one, each time from the shard that then holds most, until the new one has its share."""
    share, moved, out = sum(size.values()) / (n_shards + 1), 0, list(current)
    held: dict[int, list[tuple[int, int]]] = {k: [] for k in range(n_shards)}
    for s, k in enumerate(current):
        held[k].append((size.get(s, 0), s))
    loads = {k: sum(b for b, _ in v) for k, v in held.items()}
    for v in held.values():
        v.sort()
    while True:
        k = max(loads, key=lambda k: (loads[k], -k))
        i = next((i for i in range(len(held[k]) - 1, -1, -1) if 0 < held[k][i][0] <= share - moved), None)
        if i is None or loads[k] <= share:
            return out
        b, s = held[k].pop(i)
        out[s], moved = n_shards, moved + b
        loads[k] -= b


def map_versions(spark: SparkSession, folder: str) -> list[int]:
    """The finished versions of the map in a folder, oldest first: each is a table of its own, which counts once Spark has marked it as written whole."""
    system, where = file_system(spark, f"{folder}/version-*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().rpartition("-")[2]) for f in system.globStatus(where) or [])


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(n_slots, n_shards, vslot, part, shard, first) of a version of the map, the newest unless told otherwise. first: how many rows of the shard lie in earlier slots."""
    return spark.read.schema(MAP).parquet(f"{folder}/version-{map_versions(spark, folder)[-1] if version is None else version:06d}")


def write_map(spark: SparkSession, folder: str, version: int, entries: dict[tuple[int, int], int], held: dict, n_slots: int, n_shards: int) -> None:
    """Stores {(vslot, part): shard} as one version; what a writer that died left of it is written over. One writer at a time."""
    rows, filled = [], [0] * n_shards
    for key, k in sorted(entries.items()):
        rows.append((n_slots, n_shards, *key, k, filled[k]))
        filled[k] += held.get(key, (0, 0))[1]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("overwrite").parquet(f"{folder}/version-{version:06d}")  # 2 * n_slots rows at most


def edit_map(spark: SparkSession, folder: str, held: dict, n_slots: int, n_shards: int, tolerance: float = TOLERANCE) -> int:
    """Reads the newest version of the map, evens it out for {(vslot, part): (bytes, rows)}, stores the result as the next version and returns its number.

    An empty folder gets a first version that knows only the slots. Parts that are new start ``part`` shards after their slot's. For each shard more than the version
    has, slots go to it alone from the others; slots of shards beyond ``n_shards`` are dealt to the rest. Then slots move until bytes are even within ``tolerance``.
    """
    versions = map_versions(spark, folder)
    if not versions:
        write_map(spark, folder, 0, {(s, 0): k for s, k in enumerate(initial_map(n_slots, n_shards))}, {}, n_slots, n_shards)
        versions = [0]
    old = read_map(spark, folder, versions[-1]).collect()
    if old[0]["n_slots"] != n_slots:
        raise ValueError(f"the map in {folder} has {old[0]['n_slots']} slots, which hold for ever, not {n_slots}")
    before, shards = {(r["vslot"], r["part"]): r["shard"] for r in old}, min(old[0]["n_shards"], n_shards)
    keys = sorted({(s, 0) for s in range(n_slots)} | set(held))
    now = [before.get((s, part), before[s, 0] + part) % shards for s, part in keys]
    size = {k: held[key][0] for k, key in enumerate(keys) if key in held}
    for more in range(shards, n_shards):
        now = grown(now, size, more)
    write_map(spark, folder, versions[-1] + 1, dict(zip(keys, rebalanced(now, size, n_shards, tolerance), strict=True)), held, n_slots, n_shards)
    return versions[-1] + 1


def _placed(rows: DataFrame, n_slots: int, n_shards: int, *spread: str, folder: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` (with vslot and size) with part, and joined with the version of the map edited for them."""
    spark = rows.sparkSession
    rows, held = with_parts(rows, n_slots, *spread)
    folder = folder or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    where = read_map(spark, folder, edit_map(spark, folder, held, n_slots, n_shards, tolerance)).drop("n_slots", "n_shards")
    return rows.join(F.broadcast(where), ["vslot", "part"])  # 2 * n_slots rows at most


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, folder: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row with its shard (law ``bytes``), its place in the shard and its virtual slot, by the map in ``folder``.

    A run edits the newest version it finds there and stores the next one, so when rows were added since, only the slots that must move do (more of them the smaller
    ``tolerance``, the part of a shard by which the largest and the smallest may differ). Without a folder the map starts anew, in one of its own.

    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, part. ``slot`` counts the shard's rows from 0 without gaps, by virtual slot, part and
    doc_id. A null text has no bytes; null ids and ids that repeat are spread by their texts, and rows that repeat both by the parts of their slot, in any order; an
    empty table gives no rows. Texts are read once and never shuffled: only (doc_id, size, text_crc32) is stored and ranked, over as many keys as slots and parts.
    """
    rows = stored(measured(docs, n_slots).withColumn("nth", F.monotonically_increasing_id()), "measured")  # numbers are drawn once
    placed = _placed(rows, n_slots, n_shards, "nth", folder=folder, tolerance=tolerance)
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "part")


def shard_in_mix_order(docs: DataFrame, keep: tuple[str, ...], n_shards: int = 40, n_slots: int = N_SLOTS) -> DataFrame:
    """Every row with shard, slot and vslot and the columns named in ``keep``; ``slot`` counts the shard's rows from 0 without gaps, by the columns mix_slot and place.

    Shards are as in ``shard``; rows that repeat id and text are told apart by their place in the mix. A slot of the mix holds one block, so a range of them holds a
    bounded number of rows: places come from counts per (shard, range) and ranks inside a range. An empty table gives no rows.
    """
    rows = measured(docs, n_slots, (*keep, "mix_slot", "place")).withColumn("range", F.floor(F.col("mix_slot") / MIX_RANGE))
    rows = _placed(rows, n_slots, n_shards, "mix_slot", "place")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy("mix_slot", "place", F.col("doc_id").asc_nulls_first(), "text_crc32"))
    return rows.withColumn("rank", rank).join(starts, ["shard", "range"]).select("doc_id", *keep, "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "vslot")


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"), 40)
