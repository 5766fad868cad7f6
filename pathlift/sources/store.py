"""Run store: parquet tables per kind of result, one immutable folder per attempt, and pointers to what is published.

    <root>/<table>/run_id=<run>/attempt=<attempt>/...      rows of one attempt; never changed once written
    <root>/published/pt=../offset_days=../version=../...   one pointer per publication, written last
    <root>/partition_ranges/version=../pt=../...           rows replaced by key
    <root>/stages/entry=../...                             log of stages

Every write goes to a folder of its own, so that writers at work at the same time don't meet.

An attempt is one execution of a run. Two writers of the same run write two attempts, and a reader follows the newest
pointer once, to one of them: it never meets tables of different attempts, and a lost attempt is never met at all.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from pathlift.sources import files

# Full schemas: tables written before a column existed are read with NULL in it.
SCHEMAS = {
    "runs": "run_id string, pt string, offset_days int, config_version string, config_hash string, "
            "window_start date, window_end date, table_date_min date, table_date_max date, "
            "generated_at timestamp, duration_ms bigint, source string",
    "summary": "run_id string, total_application_count double, latest_application_count double, "
               "previous_application_count double, latest_day_change_pct double, latest_approval_rate double, "
               "latest_cid_approval_rate_pct double, approval_count double, cid_cnt double, "
               "approval_cid_cnt double, approval_jy0_count double, merged_alert_count bigint, "
               "level3_count bigint, level2_count bigint, level1_count bigint, expert_alert_count bigint, "
               "suppressed_alert_count bigint, highlight_path string, tracked_rule_count bigint",
    "daily_trend": "run_id string, date date, application_count double, approval_count double, cid_cnt double, "
                   "approval_cid_cnt double, expert_seed_count double, focus_path_count double",
    "path_daily": "run_id string, alert_id string, date date, application_count double, "
                  "total_application_count double, approval_count double, cid_cnt double, approval_cid_cnt double, "
                  "tracking_start date",
    "payloads": "run_id string, pt string, offset_days int, payload string",
}
ALERT_FIELDS = (
    "id", "canonical_path", "path", "source", "layer", "level", "level_label", "severity", "anomaly_type",
    "primary_window", "primary_window_label", "hit_windows", "hit_window_count", "observation_count",
    "growth_factor", "structure_lift_factor", "z_score", "excess_count", "relative_strength", "conditions",
    "is_expert_forced", "rule_note", "is_suppressed", "suppression_reasons", "enters_next_level",
    "drilldown_rule", "sort_rank", "approval_rate_pct", "cid_approval_rate_pct", "tracking_start",
    "is_tracked_only",
)
ALERT_SCHEMA = (
    "run_id string, id string, canonical_path string, path string, source string, layer string, level int, "
    "level_label string, severity string, anomaly_type string, primary_window string, "
    "primary_window_label string, hit_windows array<string>, hit_window_count int, observation_count double, "
    "growth_factor double, structure_lift_factor double, z_score double, excess_count double, "
    "relative_strength double, conditions array<struct<field:string,value:string,label:string>>, "
    "is_expert_forced boolean, rule_note string, is_suppressed boolean, suppression_reasons array<string>, "
    "enters_next_level boolean, drilldown_rule string, sort_rank int, approval_rate_pct double, "
    "cid_approval_rate_pct double, tracking_start date, is_tracked_only boolean"
)
SCHEMAS |= {"alerts": ALERT_SCHEMA, "suppressed": ALERT_SCHEMA, "seeds": ALERT_SCHEMA}
SCHEMAS["alert_windows"] = (
    "run_id string, alert_id string, window_key string, label string, color string, purpose string, "
    "baseline_start date, baseline_end date, observation_start date, observation_end date, baseline_days int, "
    "observation_days int, baseline_count double, observation_count double, baseline_daily double, "
    "observation_daily double, baseline_share double, observation_share double, growth_factor double, "
    "structure_lift_factor double, structure_change double, expected_count double, excess_count double, "
    "z_score double, level int, level_label string, severity string, approval_count double, "
    "approval_rate_pct double, cid_cnt double, approval_cid_cnt double, cid_approval_rate_pct double"
)
KEEP_PUBLISHED = 200
POINTER = "pt string, offset_days int, version string, run_id string, attempt string, published_at timestamp"
RANGES = "pt string, min_day date, max_day date"
STAGES = ("run_id string, attempt string, pt string, offset_days int, stage string, rows bigint, seconds double, "
          "error string, logged_at timestamp")


@dataclass(frozen=True)
class Clustered:
    """How a table that is looked up by one key lies on disk.

    Rows are dealt to shards by the key's crc32 and sorted within; a look-up lists one folder and opens the one file of
    the key's shard, where the statistics of the row groups and a bloom filter of the key leave out the rest.
    """

    key: str
    order: tuple[str, ...]
    shard_rows: int = 2_000_000
    row_group_bytes: int = 1 << 20

    def shard_of(self, key: str, shards: int) -> int:
        return zlib.crc32(key.encode()) % shards

    def write(self, df: DataFrame, path: str, expected_rows: int | None) -> None:
        shards = max(1, -(-(expected_rows or 1) // self.shard_rows))
        dealt = df.withColumn("shard", F.pmod(F.crc32(F.col(self.key).cast("binary")), F.lit(shards)).cast("int"))
        (
            dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", *self.order)
            .write.partitionBy("shard").option("compression", "zstd")
            .option("parquet.block.size", self.row_group_bytes)
            .option(f"parquet.bloom.filter.enabled#{self.key}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{self.key}", "100000")
            .parquet(f"{path}/shards={shards}")
        )


CLUSTERED = {"path_daily": Clustered("alert_id", ("alert_id", "date"))}


def stamp() -> str:
    """A name that sorts by time and is used once."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Cast to the declared schema; absent columns are NULL."""
    fields = T.StructType.fromDDL(schema).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


@dataclass(frozen=True)
class Pointer:
    pt: str
    offset: int
    version: str
    run_id: str
    attempt: str


class KeyedTable:
    """Rows that are replaced by key. An upsert adds a version of the keys it touches and reads nothing."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path, list(keys), schema

    def upsert(self, rows: DataFrame) -> None:
        """Replace the rows of every key in ``rows``; a key is replaced as a whole, other keys stay as they are."""
        out = conform(rows, self.schema).repartition(*self.keys)
        out.write.option("compression", "zstd").partitionBy(*self.keys).parquet(f"{self.path}/version={stamp()}")

    def current(self) -> DataFrame:
        """The newest version of every key; the listing chooses the folders, older versions are not opened."""
        schema = T.StructType.fromDDL(self.schema)
        pattern = "/".join([self.path, "version=*", *[f"{k}=*" for k in self.keys], "*.parquet"])
        newest: dict[tuple, str] = {}
        for file in files.matching(self.spark, pattern):  # sorted, so a later version comes later
            folder = file.rsplit("/", 1)[0]
            newest[tuple(files.named(folder)[k] for k in self.keys)] = folder
        if not newest:
            return self.spark.createDataFrame([], schema)
        with_version = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
        return files.read_folders(self.spark, with_version, self.path, list(newest.values())).select(*schema.names)


class Attempt:
    """One writer's tables of a run; readers meet them once ``publish`` has written the pointer."""

    def __init__(self, store: "RunStore", run_id: str):
        self.store, self.run_id, self.name = store, run_id, stamp()

    def path(self, table: str) -> str:
        return f"{self.store.path(table)}/run_id={self.run_id}/attempt={self.name}"

    def write(self, table: str, df: DataFrame, one_file: bool = False, expected_rows: int | None = None) -> None:
        """Write a table of this attempt; a second call for the same table is refused."""
        out = conform(df.withColumn("run_id", F.lit(self.run_id)), SCHEMAS[table]).drop("run_id")
        if table in CLUSTERED:
            CLUSTERED[table].write(out, self.path(table), expected_rows)
            return
        if one_file:
            out = out.coalesce(1)
        out.write.mode("error").option("compression", "zstd").parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        return self.store.rows(table, [(self.run_id, self.path(table))])

    def publish(self, pt: str, offset: int = 0) -> None:
        """Written last and in one file: until it is there, readers follow the pointer before."""
        row = self.store.spark.range(1).select(F.lit(datetime.now(timezone.utc)).alias("published_at"))
        row.coalesce(1).write.parquet(
            f"{self.store.path('published')}/pt={pt}/offset_days={int(offset)}/version={stamp()}"
            f"/run_id={self.run_id}/attempt={self.name}")


class RunStore:
    """Tables under one root folder, which must be shared by all executors."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.ranges = KeyedTable(spark, self.path("partition_ranges"), ["pt"], RANGES)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def attempt(self, run_id: str) -> Attempt:
        return Attempt(self, run_id)

    def _pointers(self, pt: str = "*", offset: int | str = "*") -> list[Pointer]:
        """The newest pointer of every (pt, offset) that matches, from one listing."""
        pattern = f"{self.path('published')}/pt={pt}/offset_days={offset}/version=*/run_id=*/attempt=*/*.parquet"
        newest: dict[tuple[str, str], Pointer] = {}
        for file in files.matching(self.spark, pattern):  # sorted by version within (pt, offset)
            n = files.named(file)
            newest[n["pt"], n["offset_days"]] = Pointer(
                n["pt"], int(n["offset_days"]), n["version"], n["run_id"], n["attempt"])
        return list(newest.values())

    def pointer(self, pt: str, offset: int = 0) -> Pointer | None:
        return next(iter(self._pointers(pt, offset)), None)

    def newest_pt(self, offset: int = 0) -> str | None:
        return max((p.pt for p in self._pointers(offset=offset)), default=None)

    def rows(self, table: str, folders: list[tuple[str, str]]) -> DataFrame:
        """Rows of chosen (run, folder) pairs under the full schema; empty where nothing was stored."""
        return self._read(table, [(r, f) for r, f in folders if files.exists(self.spark, f)])

    def _read(self, table: str, found: list[tuple[str, str]]) -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS[table])
        if not found:
            return self.spark.createDataFrame([], schema)
        own = T.StructType([f for f in schema.fields if f.name != "run_id"])
        rows = self.spark.read.schema(own).parquet(*[f for _, f in found])
        run = F.lit(found[0][0])
        if len(found) > 1:
            run = F.regexp_extract("_metadata.file_path", "/run_id=([^/]+)/", 1)
        return rows.withColumn("run_id", run).select(*schema.names)

    def _folders(self, table: str, run_id: str = "*") -> list[tuple[str, str]]:
        """One folder per run: that of its last published attempt, or of its newest where none was published."""
        published = {p.run_id: p.attempt for p in sorted(self._pointers(), key=lambda p: p.version)}
        root = f"{self.path(table)}/run_id={run_id}"
        # Stores written before there were attempts hold the rows in the run's own folder.
        chosen = {files.named(f)["run_id"]: f for f in files.matching(self.spark, root)}
        for folder in files.matching(self.spark, f"{root}/attempt=*"):  # sorted, so the newest comes last
            n = files.named(folder)
            if n["run_id"] not in published or n["attempt"] == published[n["run_id"]]:
                chosen[n["run_id"]] = folder
        return list(chosen.items())

    def read(self, table: str) -> DataFrame:
        """All runs, one attempt of each, under the full schema; empty when nothing was stored yet."""
        return self.rows(table, self._folders(table))

    def run(self, table: str, run_id: str) -> DataFrame:
        return self.rows(table, self._folders(table, run_id))

    def latest_runs(self) -> DataFrame:
        """Newest run of every (pt, offset)."""
        w = W.partitionBy("pt", "offset_days").orderBy(F.desc("generated_at"), F.desc("run_id"))
        return self.read("runs").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    def latest_partition(self, offset: int = 0) -> DataFrame:
        return self.pointers().where(F.col("offset_days") == offset).agg(F.max("pt").alias("latest_partition"))

    def pointers(self) -> DataFrame:
        """The published attempt of every (pt, offset), however old."""
        schema = T.StructType.fromDDL(POINTER)
        root = self.path("published")
        folders = [f"{root}/pt={p.pt}/offset_days={p.offset}/version={p.version}" for p in self._pointers()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return files.read_folders(self.spark, schema, root, folders).select(*schema.names)

    def published(self) -> DataFrame:
        """Snapshot index for listings: the newest two hundred pointers."""
        return self.pointers().orderBy(F.desc("published_at"), F.desc("pt")).limit(KEEP_PUBLISHED)

    def _published_folder(self, table: str, p: Pointer) -> str:
        return f"{self.path(table)}/run_id={p.run_id}/attempt={p.attempt}"

    def snapshot(self, table: str, pt: str, offset: int = 0) -> DataFrame:
        """Rows of the published attempt of (pt, offset); none when it was never published."""
        p = self.pointer(pt, offset)
        return self.rows(table, [(p.run_id, self._published_folder(table, p))] if p else [])

    def snapshots(self, table: str, first_pt: str = "", last_pt: str | None = None, offset: int = 0) -> DataFrame:
        """Rows of all attempts published for a closed range of partitions, with no bound by default."""
        chosen = [p for p in self._pointers(offset=offset) if first_pt <= p.pt and (last_pt is None or p.pt <= last_pt)]
        return self.rows(table, [(p.run_id, self._published_folder(table, p)) for p in chosen])

    def lookup(self, table: str, key: str, pt: str, offset: int = 0) -> DataFrame:
        """Published rows of one key of a clustered table: one pointer, one folder, one file."""
        spec, p = CLUSTERED[table], self.pointer(pt, offset)
        folders = files.matching(self.spark, f"{self._published_folder(table, p)}/shards=*/shard=*") if p else []
        of_key = {f for f in folders for n in [files.named(f)] if int(n["shard"]) == spec.shard_of(key, int(n["shards"]))}
        return self._read(table, [(p.run_id, f) for f in of_key]).where(F.col(spec.key) == key)

    def status(self, limit: int = 10) -> DataFrame:
        return self.read("runs").orderBy(F.desc("generated_at"), F.desc("run_id")).limit(limit)

    def log_stages(self, rows: list[tuple]) -> None:
        """Append to the stage log: tuples of STAGES without the time."""
        now = datetime.now(timezone.utc)
        log = self.spark.createDataFrame([(*r, now) for r in rows], STAGES)
        log.coalesce(1).write.parquet(f"{self.path('stages')}/entry={stamp()}")

    def stages(self) -> DataFrame:
        """What every attempt did: rows and seconds of each stage, and the error it ended with."""
        if not files.exists(self.spark, self.path("stages")):
            return self.spark.createDataFrame([], STAGES)
        return self.spark.read.schema(STAGES).parquet(self.path("stages")).drop("entry")

    def remove_superseded(self, before: datetime) -> int:
        """Remove attempts begun before a time that no current pointer names; returns how many folders went.

        Choose a time that no reader or writer reaches back to: an attempt still being written has no pointer yet.
        """
        kept = {(p.run_id, p.attempt) for p in self._pointers()}
        limit = f"{before.astimezone(timezone.utc):%Y%m%dT%H%M%S%f}"
        gone = 0
        for folder in files.matching(self.spark, f"{self.root}/*/run_id=*/attempt=*"):
            n = files.named(folder)
            if (n["run_id"], n["attempt"]) not in kept and n["attempt"] < limit:
                gone += files.remove(self.spark, folder)
        return gone

    def ingest(self, path: str, run_id: str, pt: str, offset: int, tables: tuple[str, ...]) -> None:
        """Store results computed elsewhere: one JSON-lines folder per table under ``path``."""
        attempt = self.attempt(run_id)
        for table in tables:
            schema = T.StructType.fromDDL(SCHEMAS[table])
            attempt.write(table, self.spark.read.schema(schema).json(f"{path}/{table}"))
        attempt.publish(pt, offset)


def config_json(cfg) -> str:
    return json.dumps(cfg.to_dict(), ensure_ascii=False, sort_keys=True, default=str)
