"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it; its queries are listed in ``tessera.llm.queries``.
"""
