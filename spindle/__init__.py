"""Spark-native preparation of multimodal training corpora and scoring of model evaluations."""
