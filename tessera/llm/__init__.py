"""Training-data operators: one module per operator, its query beside it.

Nothing outside this package (but for ``__spark_entry__`` behind a guard and
``corpus_pipeline``) imports it.
"""
