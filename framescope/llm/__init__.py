"""Operators for training-data pipelines over text and embedding tables.

Every operator is a function from DataFrame to DataFrame in a module of its own.
``queries`` binds the operators to the driver's tables.
"""
