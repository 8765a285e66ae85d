"""heddle: corpus preparation and analytics as pure DataFrame-to-DataFrame functions."""

__version__ = "0.1.0"
