"""VoxelSpark streaming."""
