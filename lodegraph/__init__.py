"""Graph and ranking analytics as lazy Spark DataFrame functions."""
