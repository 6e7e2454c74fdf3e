from .intake import pool_stream, write_pool_stream  # noqa: F401
