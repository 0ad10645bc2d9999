"""A PySpark engine for open-modification search of mass spectra."""
