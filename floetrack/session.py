"""Session factory: UTC, ANSI, AQE."""
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master=None, **conf):
    """Build (or reuse) a session. On a cluster leave ``master`` unset; submit settings win."""
    b = (SparkSession.builder.appName("floetrack")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


_LOCAL_FOLDERS = {}


def shared_folder(spark):
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir`` (or the context's checkpoint folder).

    A folder of its own is made only in local mode, where neither is set (tests); elsewhere None.
    """
    sc = spark.sparkContext
    folder = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
              or sc.getCheckpointDir())
    if folder is None and sc.master.startswith("local"):
        folder = _LOCAL_FOLDERS.get(sc.applicationId)
        if folder is None:
            folder = _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="shared-")
    return folder.rstrip("/") if folder else None


def materialize(df):
    """Cut lineage: write the frame once to the shared folder and read it back (its size is then known to the planner).

    A cluster must name the folder: without it the frame would be recomputed at every use.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
