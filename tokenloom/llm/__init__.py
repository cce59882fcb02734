"""Operators for preparing language-model training text at corpus scale.

Nothing outside this subpackage imports it; the driver contract adds its
queries only when it can be imported.
"""
