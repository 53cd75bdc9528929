"""Scratch folders for queries that write and read back."""
import uuid

from floetrack.session import shared_folder


def scratch(spark):
    """A new folder beside the cluster's checkpoint folder."""
    base = shared_folder(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{base}/scratch-{uuid.uuid4().hex}"
