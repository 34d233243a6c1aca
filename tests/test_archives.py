"""Many small archives: members leave a task together, files are made in more than one task."""

import io
import zipfile

import pyarrow as pa

from sigmaspark.plans import watch
from sigmaspark.sources import archives


def test_members_of_many_archives_leave_together():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/manifest.safe", "xyz")
        z.writestr("a/b.tif", "")
    names = [f"a{k}" for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([*names, "broken", "none"]), pa.array([held.getvalue()] * 300 + [b"broken", None])], ["path", "content"])
    out = list(archives._listed(iter([batch, batch])))
    assert len(out) == 1 and out[0].num_rows == 1200
    assert [(r["archive"], r["name"], r["size"]) for r in out[0].to_pylist()] == 2 * [(n, *m) for n in names for m in (("a/manifest.safe", 3), ("a/b.tif", 0))]


def test_archives_are_made_in_several_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert watch._archives(spark, str(tmp_path)).rdd.getNumPartitions() > 4
