from .hourly import (features_stream, hourly_stream, read_landed_stream, read_log_stream,
                     start_stream)

__all__ = ["features_stream", "hourly_stream", "read_landed_stream", "read_log_stream",
           "start_stream"]
