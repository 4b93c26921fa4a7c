"""VoxelSpark operators."""
