"""Operators for building training corpora; see the README's table of operators.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` refers to it.
"""
