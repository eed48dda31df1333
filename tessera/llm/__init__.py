"""Operations of a large training-data pipeline, one module an operator.

Nothing outside this folder imports it; ``queries`` holds the registered
queries and their SQL.
"""
