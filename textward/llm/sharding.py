"""Sharding by fixed virtual slots, native.

Records are hashed by doc_id into a fixed number of slots. Bytes are added up
per slot, and a stored map gives each slot its shard. Version 1 of a map deals
the slots out in turn, before any bytes are known; rebalance() edits a map into
its next version by moving as few slots as it can until no shard is over the
mean by more than a tolerance. Every version is kept in the shared folder under
the map's own path; the latest is loaded, edited if the bytes ask for it, and
applied as a constant array: no join and no shuffle of the documents. The law
is `bytes`: the shards' sizes are near equal, and equal texts (the groups of
the contract) may lie in different shards.

A doc_id that is null or comes more than once would put all its rows into one
slot. Such rows are hashed by doc_id, checksum, size and their place among the
rows equal to them, so a hot id or a hot record spreads over all slots, and
nothing depends on how the table is laid out.

A row's place in its shard is gapless from 0: the rows of the slots before it
in that shard, and its rank by doc_id within its slot, so no task sees a shard.

Defined cases: a null text has size 1 and the checksum of no bytes; a null
doc_id hashes as the empty string; repeated rows get places of their own; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, hadoop_path, need, shared_dir, stage, whole

SHARDS, SLOTS, TOLERANCE = 16, 4096, 0.01
#: Ids that come more than once are broadcast up to this many, else joined by shuffle; rows of a file that are
#: numbered together.
BROADCAST_IDS, RUN = 200_000, 65_536


def slot_of(key: Column, n_slots: int = SLOTS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(n_slots)).cast("int")


def first_map(n_shards: int = SHARDS, n_slots: int = SLOTS) -> list[int]:
    """Version 1 of a map: shard of each slot."""
    return [s % n_shards for s in range(n_slots)]


def rebalance(shard: list[int], slot_bytes: dict[int, int], n_shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The next version of a map, with as few slots moved as greedy choice allows.

    Slots of shards that no longer exist are moved first; then, while the
    fullest shard is over the mean by more than the tolerance, its largest slot
    that fits the emptiest shard moves there.
    """
    shard, loads = list(shard), [0] * n_shards
    for slot, k in enumerate(shard):
        if k < n_shards:
            loads[k] += slot_bytes.get(slot, 0)
    for slot in sorted((s for s, k in enumerate(shard) if k >= n_shards), key=lambda s: (-slot_bytes.get(s, 0), s)):
        to = min(range(n_shards), key=lambda k: (loads[k], k))
        shard[slot] = to
        loads[to] += slot_bytes.get(slot, 0)
    mean = sum(loads) / n_shards
    for _ in range(len(shard)):
        most, least = max(range(n_shards), key=lambda k: (loads[k], -k)), min(range(n_shards), key=lambda k: (loads[k], k))
        if loads[most] <= mean * (1 + tolerance):
            break
        room = (loads[most] - loads[least]) / 2
        fits = [s for s, k in enumerate(shard) if k == most and 0 < slot_bytes.get(s, 0) <= room]
        if not fits:
            break
        slot = max(fits, key=lambda s: (slot_bytes.get(s, 0), -s))
        shard[slot] = least
        loads[most] -= slot_bytes.get(slot, 0)
        loads[least] += slot_bytes.get(slot, 0)
    return shard


def _version(path: str, version: int) -> str:
    return f"{path}/version-{version:06d}"


def load_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The latest version of the map stored at a path, and its number; None if there is none."""
    folder, files = hadoop_path(spark, path)
    if not files.exists(folder):
        return None
    names = [str(f.getPath().getName()) for f in files.listStatus(folder)]
    # A version counts once its writer has finished.
    done = [int(n[8:]) for n in names if n.startswith("version-") and files.exists(hadoop_path(spark, f"{path}/{n}/_SUCCESS")[0])]
    if not done:
        return None
    rows = spark.read.parquet(_version(path, max(done))).collect()  # n_slots rows
    shard = [0] * len(rows)
    for r in rows:
        shard[r["slot"]] = r["shard"]
    return max(done), shard


def save_map(spark: SparkSession, path: str, version: int, shard: list[int]) -> None:
    """Store a version: slot, shard."""
    listed = F.split(F.lit(",".join(map(str, shard))), ",").cast("array<int>")
    spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).write.mode("overwrite").parquet(_version(path, version))


def current_map(spark: SparkSession, path: str, slot_bytes: dict[int, int], n_shards: int, n_slots: int) -> tuple[int, list[int]]:
    """The stored map, edited into a next version if these bytes need it; the first version is made if there is none."""
    found = load_map(spark, path)
    if found is None:
        found = 1, first_map(n_shards, n_slots)
        save_map(spark, path, *found)
    version, shard = found
    if len(shard) != n_slots:
        raise ValueError(f"the map at {path} has {len(shard)} slots, not {n_slots}: their number is fixed")
    edited = rebalance(shard, slot_bytes, n_shards)
    if edited != shard:
        version, shard = version + 1, edited
        save_map(spark, path, version, shard)
    return version, shard


def _lookup(values: list[int], slot: Column) -> Column:
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), slot)


def _twins(kept: DataFrame) -> DataFrame:
    """The staged records plus `crowded` (the doc_id is null or comes more than once) and, for those, `twin`: the
    place among equal records. Places are counted by runs of a file, so no task sees all rows of a hot record."""
    crowded = stage(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "crowded-ids")
    n = crowded.count()
    if not n:
        return kept.withColumns({"crowded": F.lit(False), "twin": F.lit(0).cast("long")})
    ids = crowded.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_many"))
    here = kept.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = here.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    rows = rows.withColumn("crowded", F.col("_many").isNotNull()).drop("_id", "_many")
    many = rows.where("crowded").withColumns({"_key": F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"), "_run": F.floor(F.col("_row") / RUN)})
    own = F.row_number().over(Window.partitionBy("_key", "_file", "_run").orderBy("_row"))
    sizes = many.groupBy("_key", "_file", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_key").orderBy("_file", "_run")) - F.col("_n")).drop("_n")
    placed = many.withColumn("_own", own).join(before, ["_key", "_file", "_run"]).withColumn("twin", F.col("_before") + F.col("_own") - 1)
    single = rows.where("not crowded").withColumn("twin", F.lit(0).cast("long"))
    names = [*kept.columns, "crowded", "twin"]
    return single.select(*names).union(placed.select(*names))


def records(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each document; the text itself is left behind."""
    text = whole(F.col("text"))
    kept = stage(need(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    ), "records")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.when(F.col("crowded"), F.concat_ws("|", own, "text_crc32", "size", "twin")).otherwise(own)
    out = stage(_twins(kept).select("doc_id", "size", "text_crc32", slot_of(key, n_slots).alias("virtual_slot")), "slotted")
    drop_staged(kept)
    return out


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The slot-to-shard map is kept at map_path; without one it lives as long as the application.
    """
    spark = docs.sparkSession
    if map_path is None:
        map_path = f"{shared_dir(spark)}/textward/slot-map-{uuid.uuid4().hex}"
        path, files = hadoop_path(spark, map_path)
        files.deleteOnExit(path)
    kept = records(docs, n_slots)
    per_slot = kept.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()  # n_slots rows
    slot_bytes = {r["virtual_slot"]: r["bytes"] for r in per_slot}
    slot_rows = {r["virtual_slot"]: r["rows"] for r in per_slot}
    version, shard = current_map(spark, map_path, slot_bytes, n_shards, n_slots)
    before, filled = [0] * n_slots, [0] * n_shards
    for s in range(n_slots):
        before[s] = filled[shard[s]]
        filled[shard[s]] += slot_rows.get(s, 0)
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return kept.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        _lookup(shard, F.col("virtual_slot")).cast("int").alias("shard"),
        (_lookup(before, F.col("virtual_slot")) + rank - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )


#: The same in DuckDB: CRC-32 byte by byte, and the rebalancing of the first map as a recursion, one moved slot a step.
SHARD_SQL = f"""
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
y AS (SELECT doc_id, n, list_transform(range(n), lambda i: ('0x' || substr(h, 1 + 2 * i, 2))::BIGINT) AS b FROM h),
e AS (SELECT doc_id, n + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS crc FROM y, tb),
w AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS own, doc_id IS NULL OR count(*) OVER (PARTITION BY doc_id) > 1 AS crowded,
  row_number() OVER (PARTITION BY doc_id, crc, size) - 1 AS twin FROM e),
d AS (SELECT doc_id, size, crc, ('0x' || substr(md5(CASE WHEN crowded THEN own || '|' || crc || '|' || size || '|' || twin ELSE own END), 1, 8))::BIGINT % {SLOTS} AS vs FROM w),
s AS (SELECT vs, sum(size)::BIGINT AS b FROM d GROUP BY vs),
sb AS (SELECT list(coalesce(b, 0)::BIGINT ORDER BY i) AS b FROM range({SLOTS}) r(i) LEFT JOIN s ON s.vs = i),
g(k, sh, loads) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda i: i % {SHARDS}),
    list_transform(range({SHARDS}), lambda p: list_sum(list_filter(b, lambda v, i: (i - 1) % {SHARDS} = p))::BIGINT) FROM sb
  UNION ALL
  SELECT k + 1, list_transform(sh, lambda v, i: CASE WHEN i = slot THEN lo - 1 ELSE v END),
    list_transform(loads, lambda v, i: CASE WHEN i = hi THEN v - best WHEN i = lo THEN v + best ELSE v END)
  FROM (SELECT *, list_position(list_transform(sh, lambda v, i: v = hi - 1 AND b[i] = best), true) AS slot FROM (
    SELECT *, list_max(list_transform(sh, lambda v, i: CASE WHEN v = hi - 1 AND b[i] <= (loads[hi] - loads[lo]) / 2.0::DOUBLE THEN b[i] ELSE 0 END)) AS best FROM (
      SELECT *, list_position(loads, list_max(loads)) AS hi, list_position(loads, list_min(loads)) AS lo FROM g, sb)
    WHERE loads[hi] > list_sum(loads)::DOUBLE / {SHARDS} * (1 + {TOLERANCE}::DOUBLE) AND k < {SLOTS}) WHERE best > 0)),
m AS (SELECT k, unnest(sh) AS p, generate_subscripts(sh, 1) - 1 AS vs FROM g WHERE k = (SELECT max(k) FROM g))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, p::INTEGER AS shard,
  row_number() OVER (PARTITION BY p ORDER BY d.vs, doc_id NULLS FIRST, crc, size) - 1 AS slot, NULL::INTEGER AS grown_shard, d.vs::INTEGER AS virtual_slot,
  CASE WHEN k > 0 THEN 2 ELSE 1 END AS map_version
FROM d JOIN m USING (vs)
"""
