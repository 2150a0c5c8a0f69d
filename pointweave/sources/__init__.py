"""Where particles and grids come from, and tables shared between jobs."""
