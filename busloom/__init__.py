"""Spark-native analytics over keyed message streams."""
