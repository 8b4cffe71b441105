"""Training-data operators: ten corpus operations and the queries that apply them.

Nothing outside this folder, ``corpus_pipeline.py`` and the entry module's guard imports it.
"""
