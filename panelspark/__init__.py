"""Spark-native operators for time-stamped panel data."""

import os

# Matrices on the driver are small, and threads of the linear algebra library may wait forever
# after the session's JVM was started; only has an effect before numpy is imported (pyspark imports it).
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
