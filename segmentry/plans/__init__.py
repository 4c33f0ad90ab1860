"""Composed flows: the bank preset, the whole segmentation, the query catalogue."""
