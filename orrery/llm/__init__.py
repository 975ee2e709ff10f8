"""Operators for building language-model training data at corpus scale.

Ten operators, one module each, all taking and returning DataFrames.  Nothing
outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
