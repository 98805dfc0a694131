"""Preparation of bulletin texts and pages for training data, as Spark jobs.

The records are the library's alert bulletins: ``alert_id`` and ``description`` (the text of an
item of the alert feed), and the pages behind their ``link``.  Column names are parameters.
Nothing else in the library imports this package.
"""
