import random

from quernstone.operators import closures, inference, ordering
from quernstone.operators.reports import ReportCache


def sets(rows):
    out = {}
    for r in rows:
        out.setdefault(r.event, set()).add(r.member)
    return out


def test_closures_come_back_as_they_were_and_take_less(spark, tmp_path):
    r = random.Random(2)
    rows, owners = [], []
    for e in range(120):
        group = range(e % 6 * 100, e % 6 * 100 + 40)
        owner = r.choice(group)
        keep = {0: 40, 1: 36, 2: 3, 3: 0}[e % 4]
        owners.append((e, owner))
        rows += [(e, m) for m in r.sample(group, keep)]
    df, own = spark.createDataFrame(rows + rows[:9], "event long, member long"), spark.createDataFrame(owners, "event long, owner long")
    kept = closures.compact(df, own)
    kept.write(str(tmp_path / "k"))
    back = closures.Compacted.read(spark, str(tmp_path / "k"))
    want = {e: {m for f, m in rows if f == e and m != dict(owners)[e]} for e, _ in owners}
    got = closures.expand(back).collect()
    assert sets(got) == {e: s for e, s in want.items() if s} and len(got) == sum(map(len, want.values()))
    n = {x.part: x.n for x in back.sizes().collect()}
    assert n["events"] == 120 and sum(n.values()) < 0.4 * len(rows)
    some = closures.closure_of(back, spark.createDataFrame([(1,), (2,), (3,)], "event long")).collect()
    assert sets(some) == {e: want[e] for e in (1, 2) if want[e]}


def one_after_the_other(groups, least):
    size = {g: len(set(i)) for g, (_, i) in groups.items()}
    used, out = set(), []
    for g in sorted(groups, key=lambda g: (-size[g] * groups[g][0], -size[g], g)):
        mine = sorted(set(groups[g][1]) - used)
        if len(mine) >= least:
            used.update(mine)
            out.append((g, len(out) + 1, mine))
    return out


def test_groups_are_chosen_as_one_after_the_other(spark):
    for seed, least in ((1, 2), (2, 3)):
        r = random.Random(seed)
        groups = {f"g{k:02}": (r.randint(1, 3), [r.randint(0, 60) for _ in range(r.randint(1, 9))]) for k in range(40)}
        df = spark.createDataFrame([(g, i, w) for g, (w, items) in groups.items() for i in items], "group string, item int, weight int")
        got = [(x.group, x.place, x["items"]) for x in inference.greedy_moves(df, "weight", least=least).orderBy("place").collect()]
        assert got == one_after_the_other(groups, least)
    assert inference.greedy_moves(df.limit(0), "weight").count() == 0


def test_places_hold_for_hot_and_null_groups(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.randint(0, 50)) for _ in range(900)]
    got = ordering.placed(spark.createDataFrame(rows, "g string, v int").repartition(5), ["g"], ["v"], "place").collect()
    for g in ("hot", "a", None):
        mine = sorted((x.place, x.v) for x in got if x.g == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for k, v in rows if k == g)


def test_a_kept_report_runs_no_job_and_any_change_misses(spark, tmp_path):
    source, made = str(tmp_path / "in"), []
    spark.range(9).write.parquet(source)

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("count(*) AS n", "sum(id) AS total")

    cache = ReportCache(spark, str(tmp_path / "cache"), keep=2)
    ask = lambda **versions: cache.report({"analyzer": 1, "state": "ok", **versions}, [source], make)
    assert ask().first().total == 36 and made == [1]
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    hit = ask()
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == jobs
    assert hit.first().n == 9 and made == [1]
    assert ReportCache(spark, str(tmp_path / "cache"), keep=2).get("none") is None
    ask(state="draft")
    assert len(made) == 2
    spark.range(1).write.mode("append").parquet(source)
    assert ask().first().n == 10 and len(made) == 3
    ask(state="draft")  # the first two have gone
    assert len(made) == 4 and len(list((tmp_path / "cache" / "reports").iterdir())) == 2
