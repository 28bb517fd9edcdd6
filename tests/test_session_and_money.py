"""Session settings from the launch are kept; money arithmetic is exact."""

import os
import random
import subprocess
import sys
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from marketlane.functions.money import apply_percent_off, half_up_div

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_build_session_keeps_launch_settings():
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from marketlane.session import build_session\n"
        "s = build_session()\n"
        "print(s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.autoBroadcastJoinThreshold'),"
        " s.conf.get('spark.sql.adaptive.autoBroadcastJoinThreshold'))\n" % REPO)
    env = dict(os.environ, PYSPARK_SUBMIT_ARGS="--conf spark.sql.shuffle.partitions=17 "
               "--conf spark.sql.autoBroadcastJoinThreshold=5MB pyspark-shell")
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().splitlines()[-1] == "17 5MB 10MB", out.stderr[-2000:]


def _py_half_up(n, d):
    q = (Decimal(abs(n)) / Decimal(d)).quantize(Decimal(1), rounding=ROUND_HALF_UP)
    return int(q) * (-1 if n < 0 else 1)


def test_half_up_division_is_exact(spark):
    rnd = random.Random(3)
    values = [0, 1, -1, 5000, -5000, 4999, 15000, -15000, 2 ** 62, -(2 ** 62), 9223372036854775807]
    values += [rnd.randint(-(10 ** 18), 10 ** 18) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    got = [r.q for r in df.select(half_up_div(F.col("n"), 10000).alias("q")).collect()]
    assert got == [_py_half_up(v, 10000) for v in values]


def test_percent_off_large_totals(spark):
    rows = [(123456789012, 1234), (99999999999, 10000), (3, 5000), (1, 11000)]
    df = spark.createDataFrame(rows, "t bigint, bp bigint")
    got = [r.v for r in df.select(apply_percent_off(F.col("t"), F.col("bp")).alias("v")).collect()]
    assert got == [_py_half_up(t * (10000 - bp), 10000) for t, bp in rows]


def test_percent_off_does_not_overflow(spark):
    big = 9223372036854775807 // 2
    df = spark.createDataFrame([(big, 2500)], "t bigint, bp bigint")
    got = df.select(apply_percent_off(F.col("t"), F.col("bp")).alias("v")).first().v
    assert got == _py_half_up(big * 7500, 10000)
