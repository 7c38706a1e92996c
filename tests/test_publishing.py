import random

import pytest
from pyspark.sql import functions as F

from harborline.functions import posting_checks as C
from harborline.operators import stores
from harborline.operators.ranking import quotas, running_totals
from tests.test_functions import value


@pytest.mark.parametrize("given, want", [("a (b", True), ("a (b) c", False), (")( ", True), ("a) b", False), ("((x)", True), ("", False), (None, False)])
def test_open_parenthesis(spark, given, want):
    assert value(spark, C.has_open_parenthesis, given) is want


@pytest.mark.parametrize("given, want", [("2026-08-04T10:00", "Aug 4, 2026"), ("2026-13-04", "2026-13-04"), ("N/A", ""), (None, ""), ("soon", "soon"), ("not verified", "")])
def test_shown_date(spark, given, want):
    assert value(spark, C.shown_date, given) == want


def test_running_totals_over_far_keys(spark):
    keys = [-(1 << 40), -5, 0, 3, 1 << 17, (1 << 17) + 1, 1 << 33, 1 << 50, (1 << 62) + 7]
    df = spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)] + [(None, 9)], "id long, v long")
    got = {r["id"]: r["total"] for r in running_totals(df, "id", "v", "total").collect()}
    assert got == {k: sum(range(i + 2)) for i, k in enumerate(keys)}


def by_hand(sizes, share):
    whole = sum(sizes.values())
    target = -int(-whole * share // 1)
    quota = {g: min(n, max(1, n * target // whole)) for g, n in sizes.items()}
    rest = {g: n * target % whole for g, n in sizes.items()}
    for step, order, most in ((1, sorted(sizes, key=lambda g: (-rest[g], g)), sizes), (-1, sorted(sizes, key=lambda g: (rest[g], g)), None)):
        moved = True
        while moved and (target - sum(quota.values())) * step > 0:
            moved = False
            for g in order:
                if (target - sum(quota.values())) * step > 0 and (quota[g] < most[g] if step > 0 else quota[g] > 1):
                    quota[g], moved = quota[g] + step, True
    return quota


@pytest.mark.parametrize("seed", range(6))
def test_quotas_by_hand(spark, seed):
    r = random.Random(seed)
    sizes = {f"g{i}": r.choice([1, 1, 2, 3, 40, 200]) for i in range(r.randint(1, 40))}
    share = r.choice([0.02, 0.25, 0.5, 0.9])
    rows = spark.createDataFrame([(g, n) for g, n in sizes.items()], "g string, n int").select("g", F.explode(F.sequence(F.lit(1), "n")))
    assert {x["g"]: x["quota"] for x in quotas(rows, "g", share).collect()} == by_hand(sizes, share)


def test_guarded_update_holds_back_what_changed(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    wanted = spark.createDataFrame([(1, "a", "x"), (2, "z", "y"), (3, None, "n"), (4, "q", "r")], "id int, before string, after string")
    new = stores.guarded_update(old, wanted, "id", "v")
    assert dict(map(tuple, new.select("id", "v").collect())) == {1: "x", 2: "b", 3: "n"}
    assert sorted(r["id"] for r in stores.not_applied(new, wanted, "id", "v").collect()) == [2, 4]
    assert stores.audit_log(wanted.filter("id = 3"), "id", "v").first()["entry"] == '{"before":null,"after":"n"}'


def test_swap_in_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 6, 12):
        stores.swap_in(spark.range(n) if n == 3 else spark.read.parquet(path).union(spark.read.parquet(path)), path)
        assert spark.read.parquet(path).count() == n
    assert spark.read.parquet(path + ".previous").count() == 6
