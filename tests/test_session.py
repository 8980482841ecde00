import os
import subprocess
import sys
import textwrap

import areapulse


def test_workers_get_the_shipped_package(tmp_path):
    """A session started elsewhere: the driver knows the package by its path only, the workers by what is shipped."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(areapulse.__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import functions as F
        from areapulse.session import build_session, ship_package
        spark = build_session("local[2]", 2, "ship")
        ship_package(spark)

        @F.udf("string")
        def where(_):
            import areapulse.functions.numeric as n
            return n.__file__

        print("from", spark.range(1).select(where("id")).first()[0])
        spark.stop()
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "from " in run.stdout and root not in run.stdout.split("from ")[1], run.stdout + run.stderr[-2000:]
