"""A PySpark engine for archives of 1-bit audio: containers as tables, their operators as DataFrame expressions."""
