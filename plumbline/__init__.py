"""plumbline: a Spark-native engine for point-in-time panels, bars and corpora."""
