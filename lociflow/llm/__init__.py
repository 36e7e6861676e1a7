"""Training-data operators.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries for the driver's entry file.
"""
