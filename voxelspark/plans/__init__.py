"""VoxelSpark plans."""
