"""A PySpark-native engine for expression specifications over trees of linked, labelled tables."""
