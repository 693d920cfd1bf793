"""Sessions made by the library carry the settings the README promises."""

from replytime.session import ensure_checkpoint_dir


def test_session_settings(spark):
    conf = spark.conf
    assert conf.get("spark.ui.enabled") == "false"
    assert conf.get("spark.sql.session.timeZone") == "UTC"
    assert conf.get("spark.python.sql.dataFrameDebugging.enabled") == "false"
    assert conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    assert conf.get("spark.sql.adaptive.enabled") == "true"
    path = ensure_checkpoint_dir(spark)
    assert path and path == spark.sparkContext.getCheckpointDir()
