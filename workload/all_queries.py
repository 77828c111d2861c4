"""Imports every query module so that its queries are registered."""

from workload import jobs, retrieval, storage, streams, texts  # noqa: F401
