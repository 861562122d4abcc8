"""Part of the mesh quality engine."""
