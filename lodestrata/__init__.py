"""lodestrata: a PySpark-native engine for facts about source code and the activity around it."""

__version__ = "0.1.0"
