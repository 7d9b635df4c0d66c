"""Landed inputs (registry, submissions, documents, model replies, API events), and sinks."""
