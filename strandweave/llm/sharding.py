"""Sharding by fixed virtual slots (DataFrame operations only).

Records are hashed into a fixed number of virtual slots, bytes are summed per
slot, and a small versioned table maps slots to shards.  Rebalancing edits that
table and leaves the hashing alone, so only the rows of moved slots travel.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
_MAP = "virtual_slot int, shard int, slot_bytes long, slot_rows long, shards int"
_ADDED = ("size", "text_crc32", "virtual_slot", "shard", "slot", "map_version")


@dataclass
class SlotMap:
    """One version of the slot-to-shard table: a fixed number of small rows, whatever the input's size."""

    shard: dict[int, int]
    bytes: dict[int, int] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    shards: int = 8
    slots: int = SLOTS
    version: int = 1

    @classmethod
    def build(cls, weights: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
        """Largest slots first, each to the lightest shard; empty slots are dealt in turn. Ties: the lower number."""
        have = {s: (b, r) for s, b, r in weights}
        load = [(0, k) for k in range(shards)]
        shard = {}
        for s in sorted(range(slots), key=lambda s: (-have.get(s, (0, 0))[0], s)):
            b = have.get(s, (0, 0))[0]
            if not b:
                shard[s] = s % shards
                continue
            total, k = heapq.heappop(load)
            shard[s] = k
            heapq.heappush(load, (total + b, k))
        return cls(shard, {s: b for s, (b, _) in have.items()}, {s: r for s, (_, r) in have.items()}, shards, slots)

    def grown(self) -> SlotMap:
        """The next version with one more shard, which takes slots from the heaviest shards until it has its share."""
        new, shard = self.shards, dict(self.shard)
        load = [0] * (new + 1)
        for s, k in shard.items():
            load[k] += self.bytes.get(s, 0)
        share = sum(load) / (new + 1)
        own: dict[int, list[tuple[int, int]]] = {}
        for s, k in shard.items():
            own.setdefault(k, []).append((self.bytes.get(s, 0), s))
        for k in own:
            own[k].sort()
        while load[new] < share:
            k = max(range(new), key=lambda i: (load[i], -i))
            fit = next((x for x in reversed(own.get(k, [])) if 0 < x[0] <= share - load[new]), None)
            if fit is None or load[k] <= share:
                break
            own[k].remove(fit)
            load[k] -= fit[0]
            load[new] += fit[0]
            shard[fit[1]] = new
        return SlotMap(shard, self.bytes, self.rows, new + 1, self.slots, self.version + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, k, self.bytes.get(s, 0), self.rows.get(s, 0), self.shards) for s, k in sorted(self.shard.items())], _MAP)

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's table; older versions stay readable, and one that is there already is an error."""
        self.frame(spark).coalesce(1).write.parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest by default. At most `slots` rows come to the driver."""
        table = spark.read.parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).select("virtual_slot", "shard", "slot_bytes", "slot_rows", "shards").collect()
        return cls({r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows if r[3]}, {r[0]: r[3] for r in rows if r[3]}, rows[0][4], len(rows), version)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """docs with size (UTF-8 bytes + 1; null: 1), text_crc32 and virtual_slot; no shuffle.

    The slot comes from the key and the text's checksum, so rows that repeat a
    key (or have none) still spread over the slots.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.withColumns(
        {
            "size": (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long"),
            "text_crc32": F.crc32(body),
        }
    ).withColumn("virtual_slot", F.pmod(F.xxhash64(F.col(key).cast("string"), F.col("text_crc32")), F.lit(slots)).cast("int"))


def slot_weights(rows: DataFrame) -> list[tuple[int, int, int]]:
    """Bytes and rows of each slot: `slots` rows at most reach the driver."""
    return [tuple(r) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()]


def plan_shards(docs: DataFrame, shards: int = 8, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> SlotMap:
    """First version of the slot map, balanced by bytes."""
    return SlotMap.build(slot_weights(sized(docs.select(key, text), key, text, slots)), shards, slots)


def assign_shards(docs: DataFrame, slot_map: SlotMap, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with size, text_crc32, virtual_slot, shard, slot and map_version.

    `slot` is the row's place in its shard, gapless from 0: the rows of the
    shard's earlier virtual slots plus the place within its own, so ranking runs
    in thousands of small windows and never in one window per shard.  Repeated
    rows get places of their own; which of two equal rows comes first does not
    show.  Null keys and null texts are ordinary values; an empty table gives none.
    """
    spark = docs.sparkSession
    base, at = {}, dict.fromkeys(range(slot_map.shards), 0)
    for s in sorted(slot_map.shard):
        base[s] = at[slot_map.shard[s]]
        at[slot_map.shard[s]] += slot_map.rows.get(s, 0)
    places = spark.createDataFrame([(s, slot_map.shard[s], base[s], slot_map.version) for s in sorted(base)], "virtual_slot int, shard int, slot_base long, map_version int")
    order = Window.partitionBy("virtual_slot").orderBy(F.col("key").asc_nulls_first(), "text_crc32", "size")
    rows = sized(docs.select(F.struct(*[c for c in docs.columns if c not in _ADDED]).alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", slot_map.slots).drop("text")
    out = rows.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(places), "virtual_slot").withColumn("slot", F.col("slot_base") + F.col("place"))
    return out.select("row.*", *_ADDED)
