"""Operators for preparing training text, and their queries.

One module per operator; ``queries.py`` registers one query for each.
Nothing outside this folder (and ``corpus_pipeline.py``) imports it."""
