"""Spark jobs that audit whether data moved between two systems arrived whole and unchanged."""
