"""Streetloom: a PySpark-native analytics engine for geotagged detections and labelled box datasets."""

__version__ = "0.1.0"
