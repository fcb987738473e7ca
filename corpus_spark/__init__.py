"""Spark-native analytics over a corpus of installed packages.

Every operator is a function from DataFrame(s) to a DataFrame; nothing here collects data to the
driver. See README.md for the map from operator ids to modules.
"""
