"""Sinks: documents, grading results, the declared party, the cache of replies."""
