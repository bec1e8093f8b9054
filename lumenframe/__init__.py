"""HDR image analytics on Spark: images as DataFrames of images, blocks and pixels."""
