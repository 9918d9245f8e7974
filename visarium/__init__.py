"""Spark-native operators for video frames, face detections, embeddings and identity clusters."""
