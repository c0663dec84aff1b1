"""Operators for training-data pipelines over ``documents``, ``pages`` and ``benchmark``.

Nothing outside this folder imports it. ``queries.py`` registers one query per
operator; the operators themselves keep general interfaces.
"""
