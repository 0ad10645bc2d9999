"""Streams of spectra."""
