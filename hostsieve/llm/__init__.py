"""Operations of a training-data pipeline: thirteen operators and their registered queries.

Nothing else in the library imports this subpackage.
"""
