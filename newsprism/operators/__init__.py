"""DataFrame operators: each is ``op(df, **params) -> DataFrame``."""
