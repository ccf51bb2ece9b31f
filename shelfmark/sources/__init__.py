"""Reading tables with roles, profiling columns, writing results."""
