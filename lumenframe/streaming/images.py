"""Image folders as streams: each new file is decoded once; every pixel operator is stateless and applies as it is."""

from pyspark.sql import DataFrame, SparkSession

from ..sources import images

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_images(spark: SparkSession, path: str, files_per_trigger: int = 64, on_error: str = "record", **options) -> DataFrame:
    """Rows of load_images for files as they arrive; unreadable ones are rows with their error, so that one bad file does not end the stream."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    return images.decoded(files.filter(images.extension(files.path).isin(*images.EXTENSIONS)), on_error, **options)
