import os

from fleetstats.plans.staging import session_folder, stage, unstage


def test_stage_reads_back_what_it_wrote_from_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(10), "ten")
    assert sorted(r.id for r in staged.collect()) == list(range(10))
    assert all(f.startswith(f"file:{named}") for f in (x.replace("file://", "file:") for x in staged.inputFiles()))


def test_a_session_folder_is_new_each_time(spark):
    one, two = session_folder(spark, "a"), session_folder(spark, "a")
    assert one != two and os.path.isdir(one) and os.path.isdir(two)


def test_unstaged_tables_are_gone_and_others_stay(spark):
    one, two = stage(spark.range(3), "one"), stage(spark.range(4), "two")
    unstage(one)
    assert not os.path.exists(one.staged_path.removeprefix("file:")) and two.count() == 4
