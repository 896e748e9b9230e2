"""answerforge: a Spark-native question-answering data engine."""

__version__ = "0.1.0"
