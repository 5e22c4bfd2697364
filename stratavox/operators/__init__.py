"""DataFrame operators on voxels, layers, graphs, fields, logs and rows."""
