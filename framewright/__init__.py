"""Integrity, measurement and change control for episodic training data, on PySpark."""

__version__ = "0.1.0"
