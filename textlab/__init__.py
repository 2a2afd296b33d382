"""Spark DataFrame operators for labelled text data.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame steps), ``plans`` (whole
pipelines made of operators) and ``streaming``.
"""
