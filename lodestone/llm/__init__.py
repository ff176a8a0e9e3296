"""Operations of a large-scale training-data pipeline.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
