"""A PySpark-native analytics engine for recordings, annotations, scores and training text."""
