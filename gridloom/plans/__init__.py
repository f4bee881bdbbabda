"""How a matrix is divided: partitions, tile grids and their filters."""
