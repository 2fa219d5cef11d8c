"""voxelake: a Spark-first engine for DICOM datasets and the data around them."""

__version__ = "0.1.0"
