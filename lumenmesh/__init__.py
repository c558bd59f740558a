"""Spark-native analytics for multi-view geometry, meshes and the catalogue data around them."""
