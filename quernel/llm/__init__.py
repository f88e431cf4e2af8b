"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage.  ``quernel.llm.catalog``
lists its queries; ``corpus_pipeline.py`` at the repository top chains five of
its operators.
"""
