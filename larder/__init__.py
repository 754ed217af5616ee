"""larder: a PySpark-native analytics engine for venue, menu and training-corpus data."""
