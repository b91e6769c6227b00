"""python on_cluster.py HOME SF OUT NAME...: queries on two executors of their own, each result written to OUT/NAME.

HOME gets the executors' folders; only HOME/shared is shared with the driver.
"""

import os
import sys
import time
from importlib.util import find_spec
from pathlib import Path


def main(home: str, sf: str, out: str, *names: str) -> None:
    for p in Path(find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":  # the executors' folders
            (Path(home) / p.name).symlink_to(p)
    os.environ |= {"SPARK_HOME": home, "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(Path(__file__).parent.parent), "SPARK_LOCAL_IP": "127.0.0.1"}
    sys.path.insert(0, os.environ["PYTHONPATH"])
    from pyspark.sql import SparkSession

    import __spark_entry__

    conf = {"spark.master": "local-cluster[2,2,1024]", "spark.executor.memory": "600m", "spark.driver.memory": "750m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4"}
    spark = SparkSession.builder.config(map=conf | {"spark.checkpoint.dir": f"file://{home}/shared"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        began = time.time()
        __spark_entry__.queries()[name](spark, sf).write.parquet(f"{out}/{name}")
        print(f"{name}: {time.time() - began:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
