"""Jobs, artifacts, uploads and evidence versions as tables: merges, guards, histories, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
ACTIVE = ["queued", "validating", "processing", "running"]
TERMINAL = ["ready", "failed", "cancelled"]
NEXT = {"queued": ["validating", "failed", "cancelled"], "validating": ["processing", "failed", "cancelled"], "processing": ["ready", "failed", "cancelled"]}
MAX_FILES, MAX_ARCHIVE, MAX_RASTER, MAX_METADATA, MAX_TOTAL = 3, 2_000_000_000, 4_000_000_000, 10_000_000, 5_000_000_000
SAFE_NAME = r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,179}$"
REQUIRED = ["overview", "scene_record", "embeddings"]


def merge_keep(stored: DataFrame, fresh: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """Upsert by key: fresh values win, but for the ``keep`` columns a null leaves the stored one."""
    columns = [c for c in stored.columns if c not in key]
    new = fresh.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_here"))
    both = stored.join(new, key, "full_outer")
    pick = lambda c: F.coalesce(f"_{c}", c) if c in keep else F.when(F.col("_here"), F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(*key, *[pick(c).alias(c) for c in columns])


def replace_newest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """One row per key: the newest, by a maximum that is taken before the exchange."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def new_version(records: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Close the current record of each key that has a fresh one, and add that as the next version."""
    last = records.groupBy(key).agg(F.max("version").alias("_last"))
    added = fresh.join(last, key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).cast("int").alias("version"), F.lit(True).alias("is_current"))
    closed = records.join(fresh.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").select(key, "version", (F.col("is_current") & F.col("_hit").isNull()).alias("is_current"))
    return closed.unionByName(added)


def patches_ready(patches: DataFrame, model: str) -> DataFrame:
    """Pending patches become ready with their model and manifest; without a manifest they stay."""
    go = (F.col("status") == "pending") & F.col("manifest").isNotNull()
    return patches.withColumn("model", F.when(go, model).otherwise(F.col("model"))).withColumn("status", F.when(go, "ready").otherwise(F.col("status")))


def soft_delete(rows: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Derived rows of the requested scenes are marked deleted, sources only where the whole scene goes."""
    r = requests.groupBy(key).agg(F.bool_or("whole_scene").alias("_whole"))
    hit = F.col("_whole").isNotNull() & (F.coalesce("_whole", F.lit(False)) | ~F.col("kind").startswith("source"))
    return rows.join(r, key, "left").withColumn("status", F.when(hit, "deleted").otherwise(F.col("status"))).drop("_whole")


def event_page(events: DataFrame, job: str, at: str, limit: int) -> DataFrame:
    """Per job the newest events below its cursor, and the cursor of the page after."""
    order = Window.partitionBy(job).orderBy(F.desc(at))
    ranked = events.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1)
    more = F.max(F.when(F.col("n") == limit + 1, F.lit(True))).over(Window.partitionBy(job))
    page = ranked.withColumn("more", more).where(F.col("n") <= limit)
    return page.withColumn("next_cursor", F.when((F.col("n") == limit) & F.col("more"), F.col(at))).drop("more")


def transition_allowed(old: Column, new: Column, kind: Column) -> Column:
    """Whether a job may go from one status to another; terminal ones never change, clean-up jobs skip validation."""
    ok = old.isNull() | (old == new)
    for status, following in NEXT.items():
        ok = ok | ((old == status) & new.isin(*following))
    return ok | ((old == "queued") & (new == "processing") & (kind == "cleanup_scene"))


def transition_check(events: DataFrame, job: str, order_by: str, status: str, kind: str) -> DataFrame:
    """Events whose status may not follow the one before."""
    before = F.lag(status).over(Window.partitionBy(job).orderBy(order_by))
    return events.withColumn("previous", before).where(~transition_allowed(F.col("previous"), F.col(status), F.col(kind)))


def backlog(dispatches: DataFrame, now: Column, lease_seconds: int, limit: int) -> DataFrame:
    """Rows that are due: waiting ones whose time has come and leases that ran out, with attempts left, oldest first."""
    due = (F.col("status").isin("pending", "retry") & (F.col("available_at") <= now)) | ((F.col("status") == "leased") & (F.col("locked_at") < now - F.make_dt_interval(secs=F.lit(lease_seconds))))
    return dispatches.where(due & (F.col("attempt") < F.col("max_attempts"))).orderBy("available_at", "created_at", "id").limit(limit)


def verify_plan(planned: DataFrame, verified: DataFrame, key: list[str]) -> DataFrame:
    """Every planned or verified file with the reason why it doesn't agree, or null."""
    v = verified.select(*key, F.col("size").alias("v_size"), F.col("checksum").alias("v_checksum"), F.lit(True).alias("v"))
    both = planned.withColumn("p", F.lit(True)).join(v, key, "full_outer")
    reason = (F.when(F.col("v").isNull(), "not_verified").when(F.col("p").isNull(), "not_planned").when(F.col("v_size").isNull() | (F.col("v_size") != F.col("size")), "size")
              .when(~F.coalesce(F.col("v_checksum").rlike("^[0-9a-f]{64}$"), F.lit(False)), "checksum_format").when(F.col("v_checksum") != F.col("checksum"), "checksum"))
    return both.select(*key, reason.alias("reason"))


def reprocess_reason(scenes: DataFrame, jobs: DataFrame, artifacts: DataFrame, key: str = "scene") -> DataFrame:
    """Whether a scene can be processed again: the first reason against it, or null."""
    busy = jobs.where(F.col("status").isin(*ACTIVE)).select(key).distinct().withColumn("busy", F.lit(True))
    source = artifacts.where(F.col("kind").startswith("source") & (F.col("status") == "available")).select(key).distinct().withColumn("source", F.lit(True))
    reason = F.when(F.col("status") == "deleting", "deleting").when(~F.col("status").isin("ready", "failed", "cancelled"), "not_reprocessable").when(F.col("busy"), "active_job").when(F.col("source").isNull(), "no_source")
    return scenes.join(busy, key, "left").join(source, key, "left").select(key, reason.alias("reason"))


def without_tasks(dispatches: DataFrame, jobs: DataFrame, tasks: DataFrame, limit: int) -> DataFrame:
    """Dispatches of processing jobs that have no tasks yet, oldest first."""
    own = jobs.where("kind = 'process_scene'").select("job")
    return dispatches.join(own, "job", "left_semi").join(tasks.select("job"), "job", "left_anti").orderBy("created_at", "job").limit(limit)


def exhausted(dispatches: DataFrame, jobs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Dispatches out of attempts whose job and scene still wait, and which of both is to be failed."""
    spent = dispatches.where(F.col("attempt") >= F.col("max_attempts")).select("dispatch", "job")
    met = spent.join(jobs.select("job", "scene", F.col("status").alias("job_status")), "job").join(scenes.select("scene", F.col("status").alias("scene_status")), "scene")
    what = F.when((F.col("job_status") == "queued") & (F.col("scene_status") == "queued"), "both").when((F.col("job_status") == "failed") & (F.col("scene_status") == "queued"), "scene").when((F.col("job_status") == "queued") & (F.col("scene_status") == "failed"), "job")
    return met.withColumn("to_fail", what).where("to_fail is not null")


def orphaned(scenes: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """Scenes that still upload without an open plan, and the status that their newest plan suggests."""
    open_ = plans.where(F.col("status").isin("open", "uploading") & (F.col("expires_at") > now)).select("scene")
    last = plans.groupBy("scene").agg(F.max_by("status", F.struct("created_at", "plan")).alias("last_plan"))
    lost = scenes.where("status = 'uploading'").join(open_, "scene", "left_anti").join(last, "scene", "left")
    return lost.select("scene", F.when(F.col("last_plan") == "completed", "queued").when(F.col("last_plan").isNull(), "draft").otherwise("failed").alias("proposed"))


def upload_reason(files: DataFrame, upload: str = "upload") -> DataFrame:
    """Why an upload's files can't be taken together, or null."""
    kind = F.col("kind")
    limit = F.when(kind == "archive", MAX_ARCHIVE).when(kind == "raster", MAX_RASTER).otherwise(MAX_METADATA)
    by = files.groupBy(upload).agg(F.count("*").alias("n"), F.count_if(kind == "archive").alias("a"), F.count_if(kind == "raster").alias("r"), F.count_if(kind == "metadata").alias("m"), F.bool_or(F.col("size") > limit).alias("big"), F.sum("size").alias("total"), F.bool_or(~F.col("name").rlike(SAFE_NAME)).alias("named"))
    reason = (F.when(F.col("n") > MAX_FILES, "too_many_files").when(F.col("named"), "name").when(F.col("big"), "too_large").when(F.col("total") > MAX_TOTAL, "total_too_large").when(F.col("m") > 1, "metadata")
              .when(((F.col("a") == 1) & (F.col("r") == 0)) | ((F.col("a") == 0) & F.col("r").between(1, 2)), None).when(F.col("a") > 1, "archives").when((F.col("a") > 0) & (F.col("r") > 0), "mixed").otherwise("no_source"))
    return by.select(upload, reason.alias("reason"))


def safe_name(name: Column) -> Column:
    """Plain ASCII letters, digits, dot, dash and underscore, not led by a dot, at most 180."""
    return name.rlike(SAFE_NAME)


def duplicate_names(files: DataFrame, upload: str, name: str) -> DataFrame:
    return files.withColumn("duplicate", F.count("*").over(Window.partitionBy(upload, F.lower(name))) > 1)


def rules(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rule, violations: rows that break each rule (a null counts as broken), in one pass."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*checks))).alias("rule", "violations"))


def lifecycle_counts(scenes: DataFrame, project: str, statuses: list[str]) -> DataFrame:
    return scenes.groupBy(project).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.count("*").alias("total"))


def ready_scenes(scenes: DataFrame, artifacts: DataFrame, vectors: DataFrame, key: str = "scene", required: list[str] | None = None) -> DataFrame:
    """Scenes that have every required artifact and a vector at least."""
    wanted = scenes.select(key).withColumn("logical_key", F.explode(F.array(*map(F.lit, required or REQUIRED))))
    missing = wanted.join(artifacts.where("status = 'available'").select(key, "logical_key"), [key, "logical_key"], "left_anti").select(key)
    return scenes.select(key).join(missing, key, "left_anti").join(vectors.select(key), key, "left_semi")


def band_stack(bands: DataFrame, scene: str = "scene") -> DataFrame:
    """Files of a scene in band order (VV first), or the reason why they can't be stacked."""
    by = bands.groupBy(scene).agg(F.count("*").alias("n"), F.count_distinct("width", "height").alias("sizes"), F.count_distinct("dtype").alias("types"), F.array_sort(F.collect_list(F.struct((~F.contains(F.lower("name"), F.lit("vv"))).alias("late"), "name"))).alias("f"))
    reason = F.when(~F.col("n").between(1, 2), "files").when(F.col("sizes") > 1, "size").when(F.col("types") > 1, "dtype")
    return by.select(scene, reason.alias("reason"), F.when(reason.isNull(), F.array_join(F.transform("f", lambda x: x["name"]), ",")).alias("bands"))


def scope_violations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages whose stated scope differs from that of their conversation; an unstated one is inherited."""
    c = conversations.select("conversation", F.col("owner").alias("_owner"), F.col("scene").alias("_scene"))
    met = messages.join(c, "conversation", "left")
    return met.where(~(F.coalesce("owner", "_owner").eqNullSafe(F.col("_owner")) & F.coalesce("scene", "_scene").eqNullSafe(F.col("_scene"))))
