"""A Spark-native engine for selecting, reshaping and editing semi-structured records."""
