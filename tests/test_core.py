"""Session helpers: partition sizing and the checkpoint folder."""

from kiln.core import PARTITION_MB, ensure_checkpoint_dir, shuffle_partitions_for


def test_shuffle_partitions_for():
    assert shuffle_partitions_for(0) == 1
    assert shuffle_partitions_for(PARTITION_MB << 20) == 1
    assert shuffle_partitions_for((PARTITION_MB << 20) + 1) == 2
    assert 740_000 < shuffle_partitions_for(100 * 10 ** 12) < 750_000


def test_checkpoint_dir_is_set(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() == d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:                                   # the session's setting is used, not a new folder
        assert conf.rstrip("/").split("/")[-1] in d or d.startswith("file:" + conf.rstrip("/"))
