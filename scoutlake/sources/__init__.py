"""Readers of the nested JSON inputs."""
