"""prepare(): runtime confs, shared checkpoint root, package shipped once."""

from fleetlane import session as S


def test_prepare_is_idempotent(spark):
    S.prepare(spark)
    root = S.checkpoint_root(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.sparkContext.getCheckpointDir() is not None
    assert S.scratch_path(spark, "x").startswith(root + "/x-")
    assert spark.sparkContext.applicationId in S._SHIPPED
    S.prepare(spark)  # second call: nothing added again
    assert S.checkpoint_root(spark) == root
