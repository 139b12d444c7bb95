"""Readers and writers: FITS, MADMAP1, observations, pipelines from configuration files."""
