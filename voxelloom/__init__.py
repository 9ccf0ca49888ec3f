"""Voxel analytics on Spark: grids, label masks and regions of interest as DataFrames."""
