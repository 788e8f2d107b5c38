"""Break segmentation of recordings on Spark."""
