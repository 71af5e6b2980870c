"""Inputs: the driver's tables, the hazard overlay, seed rows and sampled schemas."""
