"""VoxelSpark functions."""
