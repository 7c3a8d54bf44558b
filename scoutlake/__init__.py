"""Spark-native analytics over team-sport scouting data."""
