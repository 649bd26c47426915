"""Named queries: each plan joins tables of a directory with operators of the library."""
