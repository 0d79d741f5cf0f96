"""termloom: a Spark-native engine for grounding free text to concepts."""
