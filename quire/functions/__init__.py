"""Column functions: geometry of boxes and repair of scientific text."""
