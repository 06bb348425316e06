"""cuecraft: Spark-native analytics over timed transcripts and course documents."""

__version__ = "0.1.0"
