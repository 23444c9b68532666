"""Blur, minimum filter and burning on one large raster with more and more cores.

``python tools/scale.py [side] [cores,cores,...]``; prints one line per operator and core count.
The raster is generated by Spark, so this is a timing aid, not a registered query.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rasterloom.model import META_SCHEMA
from rasterloom.operators import rasterize, tiles
from rasterloom.runtime import freeze

TILE = 512


def main() -> None:
    side = int(sys.argv[1]) if len(sys.argv) > 1 else 8192
    for cores in (sys.argv[2] if len(sys.argv) > 2 else "1,2,4,8").split(","):
        spark = (
            SparkSession.builder.master(f"local[{cores}]").appName("scale").config("spark.driver.memory", "16g")
            .config("spark.sql.shuffle.partitions", "32").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
        meta = spark.createDataFrame([("r", 32736, side, side, 1, "float32", None, 0.0, 0.0, 1.0, 1.0)], META_SCHEMA)
        n = side // TILE
        value = lambda i: F.hash(F.col("id"), i).cast("double") / 1e9
        packed = freeze(spark.range(0, n * n, 1, 64).select(
            F.lit("r").alias("raster_id"), F.lit(1).alias("band"), F.expr(f"cast(id div {n} as int)").alias("ty"),
            F.expr(f"cast(id % {n} as int)").alias("tx"), F.lit(TILE).alias("h"), F.lit(TILE).alias("w"),
            F.lit(side).alias("rh"), F.lit(side).alias("rw"),
            F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), value).alias("data")))
        at = lambda k: F.pmod(F.hash(F.col("id"), F.lit(k)), F.lit(side)).cast("double")
        pt = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
        crowns = spark.range(0, side * 4, 1, 64).select("id", at(1).alias("cx"), at(2).alias("cy")).select(
            F.col("id").alias("crown_id"), F.lit("r").alias("raster_id"),
            F.array(F.array(pt(-9.3, 0.2), pt(0.1, -8.7), pt(9.6, 0.4), pt(0.3, 9.1), pt(-9.3, 0.2))).alias("rings"))
        jobs = {
            "blur sigma 8": lambda: tiles.gaussian_blur(packed, 8.0, TILE),
            "min filter 600+700": lambda: tiles.local_min_surface(packed, [600, 700], TILE),
            "smooth gradient sigma 2": lambda: tiles.smooth_gradient(packed, 2.0, TILE),
            f"burn {side * 4} polygons": lambda: rasterize.burn(crowns, meta),
        }
        for name, job in jobs.items():
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            print(f"{side}x{side}  cores {cores:>2}  {name:26s} {time.perf_counter() - start:7.2f} s", flush=True)
        spark.stop()


if __name__ == "__main__":
    main()
