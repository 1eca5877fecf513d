"""Operators on points, meshes, models and collections."""
