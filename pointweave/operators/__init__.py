"""Neighbours, smoothing, density, interpolation and deposits as DataFrame plans."""
