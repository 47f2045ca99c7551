import subprocess
import sys
import zlib
from pathlib import Path

import pyspark
import xxhash

from weft.plans.registry import QUERIES

SHOW = """
from weft.session import session
spark = session("probe", **{"spark.sql.session.timeZone": "Asia/Tokyo"})
print("FOUND", spark.sparkContext.master, spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.session.timeZone"))
"""


def test_submitted_settings_come_first(tmp_path):
    """Settings of spark-submit hold over the defaults, and the caller's over both."""
    script = tmp_path / "probe.py"
    script.write_text(SHOW)
    submit = [str(Path(pyspark.__file__).parent / "bin" / "spark-submit")]
    out = subprocess.run([*submit, "--master", "local[2]", "--conf", "spark.sql.shuffle.partitions=77", "--conf", "spark.sql.session.timeZone=Europe/Oslo", str(script)], capture_output=True, text=True, timeout=120, env=_environment())
    assert "FOUND local[2] 77 Asia/Tokyo" in out.stdout, out.stderr[-2000:]


def _environment():
    import os

    return os.environ | {"PYTHONPATH": f"{Path(__file__).parents[1]}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable, "PYSPARK_DRIVER_PYTHON": sys.executable}


def test_checksums(spark):
    for r in QUERIES["checksums"](spark, "/root/testdata/sf0.001").collect():
        data = r["s_name"].encode()
        assert r["crc"] == zlib.crc32(data) and r["xx"] % 2**64 == xxhash.xxh64_intdigest(data, seed=42)


def test_sql_leaves_no_views(spark):
    before = {t.name for t in spark.catalog.listTables()}
    QUERIES["correlated_exists"](spark, "/root/testdata/sf0.001").count()
    assert {t.name for t in spark.catalog.listTables()} == before
