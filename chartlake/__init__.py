"""chartlake: a PySpark-native engine for ranked, period-keyed data."""
