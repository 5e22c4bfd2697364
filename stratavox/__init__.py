"""Voxel layers, geology graphs, run logs and training corpora as PySpark jobs."""
