import pytest

from harborline.operators.archive import Table, is_done, move_postings, steps_of

TABLES = [Table("jobs", "id", "id", (("is_active", "0"),)), Table("details", "id", "id"), Table("changes", "change", "job_id")]


class Stop(Exception):
    pass


def stores(spark, at):
    """Current rows of three tables; the archive has one job already, with an older title."""
    spark.createDataFrame([(f"j{i}", f"title {i}", 1) for i in range(6)], "id string, title string, is_active int").write.parquet(f"{at}/current/jobs")
    spark.createDataFrame([(f"j{i}", i) for i in range(5)], "id string, pay int").write.parquet(f"{at}/current/details")
    spark.createDataFrame([(10 * i + k, f"j{i}") for i in range(6) for k in range(2)], "change int, job_id string").write.parquet(f"{at}/current/changes")
    spark.createDataFrame([("j1", "old", 0), ("j9", "kept", 0)], "id string, title string, is_active int").write.parquet(f"{at}/archive/jobs")


def rows(spark, at, store, name):
    return sorted(tuple(r) for r in spark.read.parquet(f"{at}/{store}/{name}").collect())


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def move(spark, at, wanted, before=None):
    return move_postings(spark, wanted, f"{at}/current", f"{at}/archive", TABLES, f"{at}/manifest", before)


def check_moved(spark, at):
    assert [r[0] for r in rows(spark, at, "current", "jobs")] == ["j0", "j3", "j4", "j5"]
    assert rows(spark, at, "archive", "jobs") == [("j1", "title 1", 0), ("j2", "title 2", 0), ("j9", "kept", 0)]
    assert [r[0] for r in rows(spark, at, "current", "details")] == ["j0", "j3", "j4"] and [r[0] for r in rows(spark, at, "archive", "details")] == ["j1", "j2"]
    assert [r[0] for r in rows(spark, at, "archive", "changes")] == [10, 11, 20, 21] and len(rows(spark, at, "current", "changes")) == 8


def test_stops_between_all_steps_lose_nothing(spark, tmp_path):
    """Each call does one step and is stopped before the next; the ids of the first call count."""
    at = f"file://{tmp_path}"
    stores(spark, at)
    steps = steps_of(TABLES)
    for n in range(len(steps)):
        begun = []

        def before(phase, name, begun=begun):
            if begun:
                raise Stop
            begun.append((phase, name))

        if n + 1 < len(steps):
            with pytest.raises(Stop):
                move(spark, at, ids(spark, "j1", "j2", "j2", None, "j77") if n == 0 else ids(spark, "j5"), before)
            assert not is_done(spark, TABLES, f"{at}/manifest")
        else:
            move(spark, at, ids(spark, "j5"), before)
        assert begun == [steps[n]]
        for t, size in zip(TABLES, (6, 5, 12)):  # every row is in one store at least
            there = {str(r[t.key]) for s in ("current", "archive") if (tmp_path / s / t.name).exists() for r in spark.read.parquet(f"{at}/{s}/{t.name}").select(t.key).collect()}
            assert len(there) >= size
    assert is_done(spark, TABLES, f"{at}/manifest")
    check_moved(spark, at)


def test_a_stop_between_two_renames(spark, tmp_path):
    """The old table is away and the new one not yet in its place."""
    at = f"file://{tmp_path}"
    stores(spark, at)

    def before(phase, name):
        if (phase, name) == ("release", "jobs"):
            (tmp_path / "current" / "jobs").rename(tmp_path / "current" / "jobs.previous")
            raise Stop

    with pytest.raises(Stop):
        move(spark, at, ids(spark, "j1", "j2"), before)
    move(spark, at, ids(spark, "j1", "j2"))
    check_moved(spark, at)


def test_what_the_target_lost_stops_the_move(spark, tmp_path):
    at = f"file://{tmp_path}"
    stores(spark, at)

    def before(phase, name):
        if (phase, name) == ("verify", "details"):
            spark.createDataFrame([("j1", 1)], "id string, pay int").write.mode("overwrite").parquet(f"{at}/archive/details")

    with pytest.raises(ValueError, match="details"):
        move(spark, at, ids(spark, "j1", "j2"), before)
    assert len(rows(spark, at, "current", "details")) == 5


def test_counts_of_the_manifest_and_a_repeated_move(spark, tmp_path):
    at = f"file://{tmp_path}"
    stores(spark, at)
    got = {(r["phase"], r["table"]): r["rows"] for r in move(spark, at, ids(spark, "j1", "j2")).collect()}
    assert got[("ids", "all")] == 2 and got[("verify", "changes")] == 4 and got[("release", "jobs")] == 4 and len(got) == len(steps_of(TABLES))
    move_postings(spark, ids(spark, "j1", "j2"), f"{at}/current", f"{at}/archive", TABLES, f"{at}/again")
    check_moved(spark, at)
