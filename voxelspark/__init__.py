"""VoxelSpark: volumetric images, masks and annotations as Spark DataFrames."""
