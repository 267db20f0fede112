"""Readers and writers: observations, alerts, documents, image map, series."""
