"""VoxelSpark sources."""
