"""Operators for preparing language-model training data at cluster scale.

Nothing outside this folder imports it; queries over the shared tables are in
:mod:`vectrine.llm.queries`.
"""
