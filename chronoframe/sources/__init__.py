"""Inputs and outputs: bound tables, media files, the vector table."""
