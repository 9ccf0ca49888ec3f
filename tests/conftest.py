import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (
        SparkSession.builder.master("local[8]").appName("voxelloom-tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def grid(spark):
    """Builds (voxels, volumes) from arrays: grid(name=array[z, y, x], ...)."""
    from voxelloom.model import VOLUMES

    def build(**arrays):
        cells, heads = [], []
        for name, a in arrays.items():
            nz, ny, nx = a.shape
            heads.append((name, nx, ny, nz, "float32", 0.5, 0.5, 2.0, None, False, float(a.min()), float(a.max()), None))
            cells += [(name, z, y, x, float(a[z, y, x])) for z in range(nz) for y in range(ny) for x in range(nx)]
        return (spark.createDataFrame(cells, "volume_id string, z int, y int, x int, v double"),
                spark.createDataFrame(heads, VOLUMES))
    return build


@pytest.fixture
def labels(spark):
    """Builds (mask, masks) on one volume from a label array."""
    def build(a, mask_id="m", volume_id="a", fill=0):
        nz, ny, nx = a.shape
        rows = [(mask_id, z, y, x, int(a[z, y, x])) for z in range(nz) for y in range(ny) for x in range(nx) if a[z, y, x] != fill]
        return (spark.createDataFrame(rows, "mask_id string, z int, y int, x int, class_id int"),
                spark.createDataFrame([(mask_id, volume_id, "uint8", fill, 64)],
                                      "mask_id string, volume_id string, class_data_type string, fill_value int, chunk_size int"))
    return build
