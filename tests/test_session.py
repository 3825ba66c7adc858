from pathlib import Path

from kinloom.session import Scratch, drop_scratch


def test_scratch_tables_are_dropped(spark):
    scratch = Scratch(spark, "t")
    one, two = scratch.write(spark.range(3)), scratch.write(spark.range(4))
    at = [Path(x._scratch_path.removeprefix("file://")) for x in (one, two)]
    assert two.count() == 4 and all(p.exists() for p in at)
    scratch.drop(one)
    assert not at[0].exists() and at[1].exists()
    drop_scratch(spark)
    assert not at[1].exists()
