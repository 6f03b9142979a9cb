"""Text sources with junk and several files, split boundaries, tiles, streams with late and returning users."""

import os

import pytest
from conftest import F1_ROWS, ratings_df
from pyspark.sql import functions as F

from seqrec.operators import blocks as B
from seqrec.operators import splits as SP
from seqrec.operators.pairs import pairs_within_groups
from seqrec.plans import item_based as IB
from seqrec.session import clear_scratch, path_exists, scratch_path, scratch_root
from seqrec.sources.metrics_io import write_metrics
from seqrec.sources.ratings import read_ratings, rejected_lines, write_ratings
from seqrec.streaming import blocks as SB
from seqrec.streaming import similarity as STR


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    (tmp_path / "part-0").write_text("1\t10\t5\t100\n")
    (tmp_path / "part-1").write_text("".join(f"2\t{k}\t3\t100\n" for k in range(50)))
    (tmp_path / "part-2").write_text("3\t7\t1\t100\n")
    got = [(r["user_id"], r["item_id"]) for r in read_ratings(spark, str(tmp_path)).orderBy("event_id").collect()]
    assert got == [(1, 10), *[(2, k) for k in range(50)], (3, 7)]


def test_lines_that_do_not_parse_are_returned(spark, tmp_path):
    (tmp_path / "a").write_text("user\titem\trating\tts\n1\t2\t3\t4\n1\tx\t3\t4\n5\t6\t\t8\n")
    assert read_ratings(spark, str(tmp_path)).count() == 1
    assert sorted(r["line"] for r in rejected_lines(spark, str(tmp_path)).collect()) == ["1\tx\t3\t4", "5\t6\t\t8", "user\titem\trating\tts"]


def test_null_fields_stay_in_place(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, None, 4)], "user_id bigint, item_id bigint, rating double, ts bigint")
    write_ratings(df, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1\t2\t\t4"]


@pytest.mark.parametrize("n", [0, 1, 5, 16, 99])
def test_boundary_is_the_nth_newest(spark, n):
    rows = [(1, 10, 5, 7)] * 6 + F1_ROWS + [(2, 3, 1, -5)]
    df = ratings_df(spark, rows).unionByName(ratings_df(spark, [(9, 9, 1, 1)]).withColumn("ts", F.lit(None).cast("bigint")))
    got = {(r["ts"], r["event_id"]) for r in SP.holdout_last_n(df, n=n).where("is_test").collect()}
    keys = sorted(((r[3], k) for k, r in enumerate(rows)), reverse=True)
    assert got == set(keys[:n])


def test_a_hot_key_spreads_over_join_keys(spark):
    """One key holds a third of the rows: its pairs spread over tiles, none above a small share, and none is lost."""
    rows = [(0, k) for k in range(300)] + [(1 + k % 100, k) for k in range(600)]
    df = spark.createDataFrame(rows, "g int, x int")
    pairs = pairs_within_groups(df, ["g"], ["x"], identity=["x"], condition=lambda a, b: a("x") < b("x"), tile_rows=32, materialize=False)
    assert pairs.count() == 300 * 299 // 2 + 100 * 15
    tile = F.pmod(F.xxhash64("a_x"), F.lit(10)) * 10 + F.pmod(F.xxhash64("b_x"), F.lit(10))
    most = pairs.where("g = 0").groupBy(tile.alias("t")).count().agg(F.max("count")).first()[0]
    assert most <= 0.05 * 300 * 299 / 2


def test_item_based_plan_runs(spark, f1):
    out = IB.item_based(f1, IB.ItemBasedParams(gap=10, k=3, n=3, test_n=4))
    assert out["metrics"].count() == 1 and out["recs"].columns == ["user_id", "item_id", "score", "rank"]


def test_metrics_keep_their_seconds(spark, tmp_path):
    write_metrics(spark.createDataFrame([(0.5,)], "precision double"), str(tmp_path / "m"), seconds=1.5)
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"precision": 0.5, "seconds": 1.5}


def test_scratch_needs_a_shared_folder_off_local():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        scratch_root(Session())


def test_scratch_can_be_cleared(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert path_exists(spark, path)
    clear_scratch(spark)
    assert not path_exists(spark, path) and os.path.isdir(scratch_root(spark).replace("file:", ""))


def test_a_user_who_returns_and_a_late_event(spark):
    early = [(1, 10, 1, 0), (1, 11, 1, 1), (2, 10, 1, 2)]
    middle = [(2, 10 + k, 1, 1000 + k) for k in range(5)]
    back = [(1, 12, 1, 5000), (1, 13, 1, 5001), (1, 14, 1, 9000), (2, 99, 1, 9001)]
    df = ratings_df(spark, early + middle + back)
    folders = STR.stage_chunks(df, scratch_path(spark, "t-return"), 3)
    assert len(folders) > 1
    cols = ["user_id", "block_id", "n", "idx", "item_id", "ts", "event_id"]
    want = sorted(tuple(r) for r in B.consumption_blocks(df, 10).select(*cols).collect())
    out = scratch_path(spark, "t-return-out")
    assert sorted(tuple(r) for r in STR.run_stream_blocks(spark, folders, 10, out=out).select(*cols).collect()) == want
    late = ratings_df(spark, [(1, 50, 1, 3)], shift=0).withColumn("event_id", F.lit(77).cast("bigint"))
    both = [*folders, scratch_path(spark, "t-late")]
    late.write.parquet(both[-1])
    out = scratch_path(spark, "t-late-out")
    assert sorted(tuple(r) for r in STR.run_stream_blocks(spark, both, 10, out=out).select(*cols).collect()) == want
    dropped = SB.late(spark.read.schema(SB.BLOCK_SCHEMA).parquet(out)).collect()
    assert [(r["user_id"], r["item_id"], r["event_id"]) for r in dropped] == [(1, 50, 77)]


def test_contributions_are_counted_without_a_row_for_each(spark, monkeypatch):
    """Users on one common item pair: counts before and after a time, as contributions added up give them."""
    from pyspark.sql import functions as F

    from seqrec.operators import similarity as S

    rows = [(u, i, j, (u * 7 + i) % 10) for u in range(40) for i in range(4) for j in range(i + 1, 5) if (u + i + j) % 3]
    triples = spark.createDataFrame(rows, "user_id bigint, item_i bigint, item_j bigint, born bigint")
    one = S.pair_contributions(triples)
    want = {tuple(r) for r in one.groupBy("user_a", "user_b").agg(F.count_if(F.col("born") < 5), F.count(F.lit(1))).collect()}

    def never(*_, **__):
        raise AssertionError("a row for each contribution")

    monkeypatch.setattr(S, "pairs_within_groups", never)
    assert {tuple(r) for r in S.pair_counts(triples, F.lit(5)).collect()} == want
